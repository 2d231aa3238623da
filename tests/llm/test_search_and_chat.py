import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm import chat, vafile

EMBEDDINGS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows, k, every):
    sound = [
        (i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        best = {}
        for i, u in sound:
            if i == q:
                for j, v in sound:
                    if j != q and len(u) == len(v):
                        best[j] = max(best.get(j, -(10**18)), int(u @ v))
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(order)]
    return out


def run(spark, rows, every=5, **how):
    table = spark.createDataFrame(rows, EMBEDDINGS).withColumn("v", F.lit("clash")).withColumn("key", F.lit(1))
    found = vafile.search(vafile.integer_vectors(table), F.col("vec_id") % every == 0, **how)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a hot vector, with ties
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(305, [1.0, 2.0]), (306, [0.5, 0.5]), (310, []), (311, [])]  # other lengths
    rows += [rows[5], rows[5], (5, rows[7][1]), (10, rows[9][1])]  # repeated rows, repeated ids
    expected = brute(rows, 5, 5)
    assert run(spark, rows) == expected
    assert run(spark, rows, cells=2, first_read=1) == expected  # loose bounds, many rounds


@pytest.mark.parametrize("hot", (7, 10))  # 10 is also a query
def test_topk_counts_items(spark, hot):
    rng = np.random.default_rng(4)
    lead = rng.normal(size=8)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(60)] + [(15, np.float32(lead).tolist())]
    rows += [(hot, np.float32(4 * lead + rng.normal(size=8) / 50).tolist()) for _ in range(10)]
    rows += [(hot, np.float32(rng.normal(size=8)).tolist()) for _ in range(25)]  # a third of the rows
    rows += [(40 + n, rows[62 + n][1]) for n in range(3)]  # vectors of two ids
    expected = brute(rows, 5, 5)
    assert len(expected) == 5 * 12
    assert run(spark, rows) == expected
    assert run(spark, rows, cells=2, first_read=1) == expected


def test_topk_of_few_and_of_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_bounds_hold_the_score():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (200, 6))
    cells = vafile.Cells(v.min(axis=0), v.max(axis=0), 16)
    low, high = cells.bounds(v[:20], cells.code(v))
    exact = v[:20] @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).min() >= 0


TURNS = "conv_id long, turn int, role string, text string, formatted string"


def expect(rows):
    convs = {}
    for c, n, role, text, _ in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    odd = ["<s>", "</s>", "[INST]", "<\\s>", "<\\\\/s>", "[/INST]", "\\", "<", "[", "é😀", "\n", "s>", "INST]", "$1", ""]
    rng = random.Random(3)
    rows = [
        (c, n, rng.choice(["user", "assistant", "system", "<s>[INST] "]), "".join(rng.choices(odd, k=rng.randint(0, 9))), "x")
        for c in range(60) for n in range(rng.randint(1, 7))
    ]
    rows += [(70, 0, None, None, "x"), (None, 0, "assistant", "a", "x"), (None, None, "assistant", "b", "x"), (71, 0, "user", "q", "x")]
    rows += [(72, 0, "assistant", "r", "x")] * 2 + [(73, n, ("user", "assistant")[n % 2], "long " * 40, "x") for n in range(120)]
    made = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in made.collect()}
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "")]
    assert got == expect(rows + probe)


def test_chat_examples(spark):
    rows = [(1, 0, "user", "a</s>", ""), (1, 1, "assistant", "b", ""), (1, 2, "assistant", "c", ""), (1, 3, "user", "d", "")]
    made = chat.examples(spark.createDataFrame(rows, TURNS)).orderBy("target").collect()
    assert [(r.target, r.target_turns, r.formatted[r.loss_start : r.loss_end]) for r in made] == [(1, 2, "b"), (2, 3, "c"), (3, 4, "")]
    assert made[0].formatted == "<s>user[INST] a<\\/s> [/INST]</s><s>assistant[INST] b [/INST]</s>"
    assert made[1].formatted.startswith(made[0].formatted)
    assert chat.examples(spark.createDataFrame([], TURNS)).count() == 0
