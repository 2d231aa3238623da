import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatewright.llm import resampling
from gatewright.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(docs, target, percent=5, min_words=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in docs:
        np.add.at(s, plain_features(text)[1], 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1.0) * (S + 10_000) / ((int(s[b]) + 1.0) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    left = [r for r in rows if r[4] < min_words] + fit[len(drawn) :]
    return sorted([(*r[:4], n + 1) for n, r in enumerate(drawn)] + [(*r[:4], None) for r in left], key=str)


TEXT = st.text(st.sampled_from("aZ09 .`{\x7f\x80é中 \n\t_-😀"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_features_match_the_plain_way(text):
    words, buckets = resampling.Features()(text)
    want = plain_features(text)
    assert (words, sorted(buckets.tolist())) == (want[0], sorted(want[1]))


def test_features_of_long_words():
    features = resampling.Features()
    for text in ("x" * 70 + " y", "中" * 5000 + " a b " + "é" * 40_000, "w " * 50_000, None, ""):
        words, buckets = features(text)
        want = plain_features(text)
        assert (words, sorted(buckets.tolist())) == (want[0], sorted(want[1]))


def check(spark, docs, target, **how):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, score string, high int, rank int")
    aim = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(table.repartition(5), aim, **how).collect()), key=str)
    assert got == plain(docs, target, **how)
    return got


def test_documents_match_the_plain_way(spark):
    rng = random.Random(1)
    vocabulary = [f"word{n}" for n in range(80)] + ["Été", "中文", "a", "B"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (None, "one two " * 15), (None, None), (502, "long text " * 60_000)]
    docs += [(600, "same words here again and more " * 5)] * 150  # repeated rows: a hot key among the scores
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None, ""]
    got = check(spark, docs, target)
    assert [r[4] for r in got].count(None) < len(docs)
    check(spark, docs, target, percent=60)
    check(spark, docs, [])


@pytest.mark.parametrize("docs", [[], [(1, "a b")], [(n, "w " * 20) for n in range(19)], [(n, "w " * 20) for n in range(20)]])
def test_few_documents(spark, docs):
    check(spark, docs, ["w"])


def test_ranks_are_exact_for_any_keys(spark):
    rng = random.Random(2)
    keys = [(rng.randrange(-40, 40), rng.randrange(3)) for _ in range(3000)] + [(7, 1)] * 1500 + [(-(1 << 62), -(1 << 63))]
    table = spark.createDataFrame(keys, "high long, low long").repartition(7)
    for take in (0, 1, 777, 4501, 9999):
        rows = resampling.ranked(table, Scratch(spark), lambda n: take, segments=16).collect()
        assert [(r.high, r.low) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == sorted(keys)[:take]
        assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, min(take, len(keys)) + 1))
        assert sorted((r.high, r.low) for r in rows) == sorted(keys)


def test_splitters_split_evenly(spark):
    rng = random.Random(3)
    keys = [(rng.gauss(0, 1000).__int__(), n) for n in range(8000)]
    table = spark.createDataFrame(keys, "high long, low long").repartition(9)
    cuts = resampling.splitters(table, 10, samples=64, groups=3)
    sizes = np.bincount(resampling.segments_of(np.array(keys), cuts), minlength=10)
    assert sizes.min() > 500 and sizes.max() < 1200


def test_equal_keys_are_dealt_to_all_their_segments(spark):
    cuts = np.array([(1, 1), (5, 5), (5, 5), (5, 5), (9, 9)])
    keys = np.array([(5, 5)] * 9 + [(0, 0), (1, 1), (1, 2), (6, 0), (9, 9), (9, 10)])
    got = resampling.segments_of(keys, cuts).tolist()
    assert sorted(got[:9]) == [1, 1, 1, 2, 2, 2, 3, 3, 3] and got[9:] == [0, 0, 1, 4, 4, 5]


def test_noise_is_that_of_the_formula(spark):
    got = [r[0] for r in spark.range(50).select(resampling.noise(F.col("id"))).collect()]
    h = [int(hashlib.sha256(f"42:{n}".encode()).hexdigest()[:8], 16) for n in range(50)]
    assert got == [math.floor(-1000 * math.log(-math.log((x + 0.5) / 2**32))) for x in h]
