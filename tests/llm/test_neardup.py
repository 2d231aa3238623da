import random
import re

import pytest

import corpus_pipeline
from gatewright.llm import neardup
from gatewright.llm.common import Scratch

DOCS = "doc_id long, text string, node string, digest string, component string"


def word_shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = {i: word_shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    docs, passage = {}, words(rng, 60)

    def put(text):
        docs[len(docs)] = " ".join(text)

    for _ in range(60):
        put(words(rng, rng.randint(1, 90)))
    for _ in range(60):  # a shared passage is no near copy
        put(words(rng, rng.randint(0, 60)) + passage + words(rng, rng.randint(0, 60)))
    base = words(rng, 150)
    for _ in range(120):  # a family around one text, from one changed word to many
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
        put(copy)
    for cut in range(60):  # a chain of shorter and shorter copies
        put(base[: 150 - 2 * cut])
    for n in range(30):
        put(list(base) if n % 2 else [w.upper() for w in base])
    for n in (1, 2, 4, 5, 6, 9, 10):
        for _ in range(3):
            put(base[:n])
    for n in range(12):
        put(base[: 10 + n])
    return docs


def test_components_match_brute_force(spark, planted):
    rows = [(i * 3, t, "x", "y", "z") for i, t in planted.items()]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    expected = {3 * i: (n, 3 * c) for i, (n, c) in brute(planted).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == brute(texts)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "one"), (None, "two"), (6, "é É"), (7, "é é")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 1, 0, True), (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True),
        (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True),
    ]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 400), (400, 1000), (7, 7), (500, 900), (900, 600), (600, 901)]
    random.Random(1).shuffle(links)
    found = dict(map(tuple, neardup.components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(301), 0), 400: 400, 1000: 400, **dict.fromkeys((500, 600, 900, 901), 500)}


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [r.doc_id for r in docs.collect()]
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and after
        if name == "near_duplicates":
            components = brute({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in components.items() if i == c}
        if name == "personal_data":
            assert set(after) == set(before) and any("[" in r.text and r.text != before[i].text for i, r in after.items())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
    assert len(after) < len(seen)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(after)


def test_pipeline_takes_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(odd.selectExpr(*(f"CAST({c} AS {t}) AS {c}" for c, t in docs.dtypes))).unionByName(docs.limit(3))
    docs = docs.selectExpr("*", "1 AS row", "2 AS judged", "3 AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf_dir).count() == 0
