import html as references
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import html, langid, pii, quality, rules

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string, r string, predicted string"
LABELS = "doc_id long, quality int, toxic int, text string"


def held_accuracy(found, truth):
    rows = found.where("held_out").join(truth, "doc_id").collect()
    return sum(r.truth == r.guess for r in rows) / len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "pages")}


def test_quality_held_out(tables):
    found = quality.classify(tables["documents"], tables["labels"]).withColumn("guess", F.col("predicted"))
    assert found.count() == tables["documents"].count()
    assert held_accuracy(found, tables["labels"].select("doc_id", F.col("quality").alias("truth"))) > 0.95


def test_quality_edges(spark):
    rows = [(i, ("fine words here" if i % 2 else "&&& ### ***") * 5, "en", "", "", "") for i in range(40)]
    rows += [(50, None, None, "", "", ""), (51, "", None, "", "", ""), (52, " ", None, "", "", ""), (None, "fine", "", "", "", ""), (1, "fine", "", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] + [(7, 1, 0, "x"), (3, None, 0, "x"), (None, 1, 0, "x")], LABELS)
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id != 1}
    assert all(by_id[i].predicted == i % 2 for i in range(40) if i != 1)
    assert by_id[50].score == by_id[51].score == by_id[52].score and not by_id[None].held_out
    none = quality.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_quality_features_by_hand():
    assert quality.features("a a b").tolist().count(1) == 1  # the pair of equal words
    assert quality.features("").tolist() == quality.features(None).tolist() == quality.features(" \n").tolist() == [0]
    one, two = quality.features("hello world"), quality.features("hello  \n world")
    assert sorted(one.tolist()) == sorted(two.tolist())
    assert Counter(quality.features("hello").tolist()) <= Counter(one.tolist())
    assert len(quality.features("ab " * 50_000)) > 100_000


def plain_features(text, bits):
    """The same buckets from Python numbers: one word, pair and gram after another."""
    mask, c = (1 << 64) - 1, [int(x) for x in quality._C]
    words = [w for w in re.split("[\x00-\x20\x85\xa0\u2000-\u200a\u3000]+", text or "") if w]
    if not words:
        return [0]

    def bucket(h):
        return max(2, (((h ^ (h >> 31)) * c[4]) & mask) >> (64 - bits))

    power = [pow(0x9E3779B97F4A7C15 | 1, n + 1, 1 << 64) for n in range(quality._MAX_POWER)]
    # The blank behind a word adds its power less itself.
    hashes = [(sum(ord(x) * power[n + 1] for n, x in enumerate(w)) + power[0] - 1) & mask for w in words]
    out = [0] + [1] * sum(a == b for a, b in zip(hashes, hashes[1:]))
    out += [bucket(((h ^ (h >> 29)) * c[5]) & mask) for h in hashes]
    out += [bucket(((a * c[6] + b) * c[7]) & mask) for a, b in zip(hashes, hashes[1:])]
    for w in words:
        padded = [1, *map(ord, w), 1]
        for n in range(len(padded) - 2):
            out.append(bucket(((padded[n] * c[0] + padded[n + 1] * c[1] + padded[n + 2] * c[2]) * c[5]) & mask))
        for n in range(len(padded) - 3):
            three = padded[n] * c[0] + padded[n + 1] * c[1] + padded[n + 2] * c[2]
            out.append(bucket(((three * c[3] + padded[n + 3] * c[4]) * c[6]) & mask))
    return out


def test_quality_training_matches_a_plain_version(spark, monkeypatch):
    for text in ("a", "ab cd", "hello hello world", "été  中文\n x"):
        assert sorted(quality.features(text).tolist()) == sorted(plain_features(text, quality.BUCKETS_LOG2))
    monkeypatch.setattr(quality, "STEPS", 120)
    texts = ["fine words here", "&& ## **", "more fine words", "## $$ &&", "words", "** now"]
    labels, bits, size = [1, 0, 1, 0, 1, 0], 9, quality.DIMENSIONS
    docs = [np.unique([b % (1 << bits) for b in plain_features(t, quality.BUCKETS_LOG2)], return_counts=True) for t in texts]
    learned = quality.train(docs, np.array(labels), bits=bits, seed=3)
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1.0 / size, 1.0 / size, (1 << bits, size)).tolist()
    weights = [[0.0, 0.0] for _ in range(size)]
    step = 0
    for _ in range(20):
        for i in rng.permutation(len(docs)):
            rate = quality.RATE * (1 - step / 120)
            step += 1
            buckets, counts = docs[i][0].tolist(), docs[i][1].tolist()
            share = [n / sum(counts) for n in counts]
            hidden = [sum(s * vectors[b][d] for s, b in zip(share, buckets)) for d in range(size)]
            z = [sum(hidden[d] * weights[d][k] for d in range(size)) for k in range(2)]
            p = [math.exp(z[k] - max(z)) / sum(math.exp(y - max(z)) for y in z) - (k == labels[i]) for k in range(2)]
            back = [sum(weights[d][k] * p[k] for k in range(2)) for d in range(size)]
            for d in range(size):
                for k in range(2):
                    weights[d][k] -= rate * hidden[d] * p[k]
                for s, b in zip(share, buckets):
                    vectors[b][d] -= rate * s * back[d] * len(buckets) ** 0.5
    logit = [sum(v[d] * (weights[d][1] - weights[d][0]) for d in range(size)) for v in vectors]
    assert learned.logit == pytest.approx(logit, abs=1e-3) and max(map(abs, logit)) > 0.5


def test_quality_sample_does_not_depend_on_the_layout(spark):
    rows = [(i, ("fine words here" if i % 2 else "&&& ### ***") * 3, "", "", "", "") for i in range(60)]
    rows += [(4, f"other text {n} of one id", "", "", "", "") for n in range(200)] + [(6, None, "", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)] * 2 + [(4, 1, 0, "x")], LABELS)
    models = [quality.learn(d, labels, sample_counts=n) for d in (docs.repartition(7), docs.orderBy(F.col("text").desc()).coalesce(1)) for n in (300, 1 << 30)]
    assert np.array_equal(models[0].logit, models[2].logit) and np.array_equal(models[1].logit, models[3].logit)
    assert not np.array_equal(models[0].logit, models[1].logit)


def test_language_held_out(tables):
    found = langid.identify(tables["documents"]).withColumn("guess", F.col("lang_pred"))
    assert held_accuracy(found, tables["documents"].select("doc_id", F.col("lang").alias("truth"))) > 0.95


def naive_grams(text):
    words = re.split(r"\x01+", "".join(c if c.isalpha() else "\x01" for c in text.lower()))
    count = Counter()
    padded = "\x01" + "\x01".join(w for w in words if w) + "\x01"
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram == "\x01" or (n == 3 and gram[1] == "\x01"):
                continue
            count[sum(ord(c) << 21 * k for k, c in enumerate(gram))] += 1
    return sorted(count.items(), key=lambda x: (-x[1], x[0]))


def test_language_by_hand(spark):
    for text in ("Ab ba, ÄB!", "x", "a1b2 c", "été " * 50):
        keys, counts = langid.ranked_grams(text)
        assert list(zip(keys.tolist(), counts.tolist())) == naive_grams(text)
    rows = [(i, t, lang, "", "", "") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8)]
    rows += [(90, None, "en", "", "", ""), (91, "12 !?", "de", "", "", ""), (92, "the dog", None, "", "", ""), (None, "der hund", "fr", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    learned = langid.learn_profiles(langid.training_rows(docs), size=30)
    assert learned.languages == ["de", "en"]  # a row without doc_id teaches nothing
    texts = [r.text for r in langid.training_rows(docs).where("lang = 'en'").collect() if r.text]
    top = naive_grams(" ".join(texts))[:30]
    for gram, place in [(g, p) for p, (g, _) in enumerate(top)]:
        assert learned.place[1, np.searchsorted(learned.grams, gram)] == place
    keys = langid.ranked_grams("the hund")[0]
    places = {g: p for p, (g, _) in enumerate(top)}
    assert langid.out_of_place(learned, keys)[1] == sum(min(30, abs(places[g] - n)) if g in places else 30 for n, g in enumerate(keys.tolist()))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(16))
    assert (got[90].lang_pred, got[91].lang_pred, got[92].lang_pred, got[None].lang_pred) == ("und", "und", "en", "de")
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_pii_base_spans():
    rng = random.Random(7)
    card = "4111 1111 1111 1111"
    texts = ["".join(rng.choices("01259..@@+-- ()aZ_%é", k=rng.randint(1, 60))) for _ in range(4000)]
    texts += [f"x {card}, +1 (743) 555-3824 a.b@c-d.e 1.2.3.4.5.6.7.8", "9" * 20_000, "a" * 20_000 + "@", "1." * 5000, "a@b.c_x@y.z"]
    for text in texts:
        assert [s[:3] for s in pii.find_spans(text) if s.kind in BASE] == plain_spans(text)


def test_pii_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("iban DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("iban DE88 3704 0044 0532 0130 00") == []
    assert kinds("ssn 219-09-9999") == ["ssn"] and kinds("219-09-9999") == [] and kinds("sample ssn 219-09-9999") == []
    high, low = pii.find_spans("card 4111111111111111")[0].score, pii.find_spans("order 4111111111111111")[0].score
    assert high > low  # a base span stays, whatever its score
    text = "mail a@b.c or 1.2.3.4"
    assert pii.redact(text, pii.find_spans(text)) == "mail [EMAIL] or [IP]"


def test_pii_account_ends():
    for number in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for tail in ("", " BIC: COBADEFFXXX", " 2024", " OR call", " A 1 B 2 C 3", " " + number, ". END"):
            for head in ("", "IBAN: ", "AB12 3456 7890 1234 "):
                text = head + number + tail
                spans = [(s.start, s.end) for s in pii.find_spans(text) if s.kind == "iban"]
                assert spans[:1] == [(len(head), len(head + number))] and len(spans) == 1 + (tail == " " + number)
    unlisted = next(f"QQ{n:02d}1234567890AB" for n in range(100) if pii.mod97(f"QQ{n:02d}1234567890AB"))
    assert list(pii.accounts(f"{unlisted} 2024 X")) == [(0, len(unlisted))]
    assert not list(pii.accounts("DE89370400440532013000OR")) and not list(pii.accounts("DE89 3704 0044 0532 0130 01 2024"))
    assert not list(pii.accounts("AA11 " * 20_000))


def test_pii_long_texts():
    unit = "mail a.b@c-d.org or ssn 219-09-9999, card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00; 10.0.0.1 +1 743 555 3824\n"
    text = unit * (5_000_000 // len(unit))
    start = time.process_time()
    spans = pii.find_spans(text)
    assert time.process_time() - start < 60
    assert Counter(s.kind for s in spans) == dict.fromkeys(pii.KINDS, text.count("\n"))
    assert pii.redact(text, spans).count("[SSN]") == text.count("\n")


def test_pii_overlaps_match_the_plain_way():
    rng = random.Random(10)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        taken = pii._Taken(spans)
        for start in range(0, 70, 3):
            for end in range(start + 1, start + 9):
                assert taken.overlaps(start, end) == any(s < end and start < e for s, e in spans)


def test_pii_rows(spark):
    rows = [(1, "a@b.c", "", "", "", ""), (1, "a@b.c", "", "", "", ""), (None, "é 1.2.3.4", "", "", "", ""), (2, None, "", "", "", "")]
    got = pii.report(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got] == [(1, 1, 0, "email:0:5")] * 2 + [(None, 0, 1, "ip:2:9"), (2, 0, 0, "")]
    assert pii.report(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_words():
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice([b"a", b"b"]) if rng.random() < 0.8 else b"%d" % rng.randint(0, 99) for _ in range(rng.randint(0, 40))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert rules.repeated_words(words) == len(inside)


def test_rules_by_hand(spark):
    clean = [f"the words of text number {i} are good and they say what a text says" for i in range(60)]
    junk = ["buy$$$ now### cheap*** pills&&& click%%% here||| free$$$ cash### win*** big&&&"] * 60
    texts = [*clean, *junk, "x", "a b c d e f g h i j k\n\n a\n b\n a\n", None, "same same " * 40]
    docs = spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts)] + [(None, clean[0], "", "", "", "")], DOCS)
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(60)] * 2 + [(70, 0, 0, "x"), (None, 1, 0, "x")], LABELS)
    got = {r.doc_id: r for r in rules.assess(docs, labels).collect()}
    assert len(got) == len(texts) + 1
    raw, trusted = np.zeros(1 << rules.BUCKETS_LOG2), np.zeros(1 << rules.BUCKETS_LOG2)
    for i, t in enumerate([*texts, clean[0]]):
        own = rules.buckets(rules.ascii_words(t))
        np.add.at(raw, own, 1)
        if i < 60:
            np.add.at(trusted, own, 1)
    log = np.log((trusted + rules.PRIOR) / (raw * trusted.sum() / raw.sum() + rules.PRIOR))
    for i, t in enumerate(texts):
        own = rules.buckets(rules.ascii_words(t))
        assert got[i].llr == pytest.approx(log[own].mean() if len(own) else 0.0)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 120))
    assert (got[120].n_words, got[120].base_failed) == (1, True) and (got[122].n_words, got[122].kept) == (0, False)
    odd = got[121]
    assert (odd.n_words, odd.word_chars, odd.n_dup_lines, odd.n_symbols) == (14, 14, 1, 0)
    assert got[123].base_failed and got[60].n_symbols == 30
    assert rules.assess(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r.llr for r in rules.assess(docs, spark.createDataFrame([], LABELS)).collect()} == {0.0}


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="a">News</a></li></ul></nav>
<div id="cookie-notice"><p>We use the cookies of this site for you and for all of the people that are on it.</p></div>
{article}<aside class="sidebar"><p>The best of the week and of the month, for you and for all.</p></aside>
<div class="comments"><p>I think that this is the best story of all and that it was told as it had to be.</p></div>
<form><input name=q><button>Go</button></form><footer>&copy; the site</footer></body></html>"""
TEXT = "<h1>A&amp;B</h1><p>It was  the\nbest of times, it was the worst of times, and it was all in the book that he had to read.<p>Short.<p>Fin&eacute;<!-- <p>no</p> -->"
MAIN = "A&B\nIt was the best of times, it was the worst of times, and it was all in the book that he had to read.\nShort.\nFiné"


def test_html_templates():
    for tag in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>"):
        assert html.main_text(PAGE.format(article=tag.format(TEXT))) == MAIN
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><!--") == ""
    for hostile in ('<a "' * 20_000, "<" * 50_000, "<p>" * 20_000, "<script>" * 20_000, "<select>" * 20_000, "</div>" * 20_000):
        html.main_text(hostile)


def test_html_containers_of_articles():
    inner = f"<article>{TEXT}</article>"
    for name in ("container has-sidebar", "layout with-sidebar", "layout--with-sidebar", "post has-comments", "post comments-open",
                 "elementor-widget elementor-widget-text-editor", "content-sidebar-wrap", "page-header"):
        assert html.main_text(PAGE.format(article=f'<div class="{name}">{inner}</div>')) == MAIN, name
        assert html.main_text(f'<body><nav>A b</nav><div class="{name}"><div>{TEXT}</div></div>') == MAIN, name
        assert html.main_text(PAGE.format(article=f'<div class="{name}"><main>{TEXT}<div class="share">of the</div></main></div>')) == MAIN, name
    for page in (f"<form>{inner}</form>", f"<form><div>{TEXT}</div></form>", f"<main><form>{TEXT}</form></main>", f"<form role=form><main>{TEXT}</main></form>"):
        assert html.main_text(f"<body>{page}</body>") == MAIN
    assert html.main_text(f'<div class="ad"><div>{TEXT}</div></div><article><p>It is.</p></article>') == "It is."
    teaser = "<article><p>The best of the week and of the month, for you and for all of the people here.</p></article>"
    for name in ("sidebar", "comments", "related-posts", "widget-area"):
        assert html.main_text(PAGE.format(article=f'{inner}<div class="{name}">{teaser}</div>')) == MAIN, name


def test_html_in_other_languages():
    texts = {
        "ru": "Это было лучшее из времён и худшее из времён, и всё это стояло в книге, которую он читал вечером у окна своего дома.",
        "pt": "Foi o melhor dos tempos e foi o pior dos tempos, e tudo isso estava no livro que ele lia à noite perto da janela.",
        "tr": "Zamanların en iyisiydi, zamanların en kötüsüydü ve bunların hepsi akşamları pencerenin yanında okuduğu kitapta yazıyordu.",
        "zh": "那是最美好的时代，那是最糟糕的时代。" * 6,
    }
    for text in texts.values():
        body = f"<h1>{text[:20]}</h1><p>{text} {text}</p><p>{text[:30]}</p><p>{text} {text}</p>"
        want = f"{text[:20].strip()}\n{text} {text}\n{text[:30].strip()}\n{text} {text}"
        links = "".join(f"<li><a href=/{n}>{text[:25]}</a></li>" for n in range(9))
        for tag in ("<div class=content>{}</div>", "<div>{}</div>", "<article>{}</article>", "<div class=widget>{}</div>"):
            page = f"<body><nav><ul>{links}</ul></nav><div><ul>{links}</ul></div>{tag.format(body)}<footer><p>{text}</p></footer></body>"
            assert html.main_text(page) == want, (tag, text)


def test_html_ties_of_neighbours():
    good, bad, short = (html.Block(t, 0, False, 0, False, label) for t, label in (("g", "good"), ("b", "bad"), ("s", "short")))
    for order, want in (([good, short, bad], "good"), ([bad, short, good], "good"), ([bad, short, bad], "bad"), ([good, bad, short], "bad")):
        blocks = [html.Block(b.text, 0, False, 0, False, b.label) for b in order]
        html.second_pass(blocks)
        assert next(b for b in blocks if b.text == "s").label == want


def test_html_long_values():
    for n in (10, 400, 5000):
        value = "<p>of the and to in a is that</p>" * n
        for start in (f'<div data-x="{value}">', f"<div data-x='{value}' id=a>", f'<div data-x = "{value}"/>'):
            assert html.main_text(f"<article>{start}{TEXT}</div></article>") == MAIN
    stray = '<p title="x>' + "It was the best of times and it was the worst of times. " * 20 + '</p><p class="y">The end of it was that it was.</p>'
    assert "worst of times" in html.main_text(f"<article>{stray}</article>")
    for hostile in ('<a b="' * 20_000, "<a b='\"" * 20_000, '<a b="<" ' * 20_000, '<a b="' + "<c d='" * 20_000, "<a '\"" * 20_000):
        html.main_text(hostile)


def test_html_articles(tables):
    got = {r.page_id: r for r in html.extract(tables["pages"]).collect()}
    pages = tables["pages"].collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"(?s)<article>(.*)</article>", page.html)[1]
        words = references.unescape(re.sub(r"<[^>]*>", " ", inside)).split()
        text = got[page.page_id].text
        assert text.split() == words and len(text) == got[page.page_id].n_chars


def test_html_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", "<main><p>a</p></main>", "x")] * 2 + [(None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", "a", 1)] * 2 + [(None, None, "", 0)]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
