import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from gatewright.llm import repair

TURNS = "conv_id long, turn long, role string, text string, copies string, digest int"
WHITE = " \t\n\x0b\x0c\r"


def all_edits(rows):
    """Every way to edit rows of (role, text, must_go, extra) with at most two insertions in a row: (cost, audit, lines)."""

    def inserts():
        for n in range(3):
            yield from itertools.product(("user", "assistant"), repeat=n)

    ways = []
    options = []
    for role, text, gone, extra in rows:
        here = [(3, "D", [])]
        if not gone:
            here.append((extra, "K", [(role, text)]))
            here += [(2 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(here)
    gaps = list(inserts())
    for picks in itertools.product(*options):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for n, added in enumerate(filled):
                cost += 2 * len(added)
                audit += "I" * len(added)
                lines += [(r, "") for r in added]
                if n < len(picks):
                    cost += picks[n][0]
                    audit += picks[n][1]
                    lines += picks[n][2]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                ways.append((cost, audit, lines))
    return ways


def plain_best(rows):
    """The same by dynamic programming from the start, over (cost, audit, lines) of each state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def close(best):
        for _ in range(3):
            for q in list(best):
                for r in ("user", "assistant"):
                    if to := step[q].get(r[0]):
                        new = (best[q][0] + 2, best[q][1] + "I", best[q][2] + [(r, "")])
                        best[to] = min(best.get(to, new), new)
        return best

    best = close({"": (0, "", [])})
    for role, text, gone, extra in rows:
        new = {}
        for q, (cost, audit, lines) in best.items():
            ways = [(q, (cost + 3, audit + "D", lines))]
            if not gone:
                ways += [(step[q].get(role[:1]), (cost + extra, audit + "K", lines + [(role, text)]))]
                ways += [(step[q].get(r[0]), (cost + 2 + extra, audit + "R", lines + [(r, text)])) for r in ("user", "assistant")]
            for to, way in ways:
                if to is not None:
                    new[to] = min(new.get(to, way), way)
        best = close(new)
    return min(best[q] for q in ("", "a") if q in best)


def plain(rows):
    """The whole contract, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in out if t is not None]
        seen, counts, judged = set(), [0, 0, 0], []
        for _, role, text in out:
            bare = text.rstrip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), int(fault == 2)))
        initials = [r[:1] for _, r, _ in out]
        illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(initials, initials[1:]))
        cost, audit, lines = plain_best(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        result[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return result


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    return {r[0]: tuple(r)[1:] for r in repair.repair_conversations(table).collect()}


KINDS = [("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t"), ("", "e")]


def test_plain_best_is_the_best_of_all_edits():
    rng = random.Random(5)
    for size in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = [(*rng.choice(KINDS), rng.random() < 0.2, rng.randint(0, 1)) for _ in range(size)]
        assert plain_best(rows) == min(all_edits(rows))


def test_block_tables_match_the_plain_way():
    rng = random.Random(6)
    for size in [*range(13), 50, 51, 400]:
        for _ in range(20):
            symbols = np.array([rng.randrange(repair.SYMBOLS) for _ in range(size)], np.int64)
            names = ("system", "user", "assistant", "tool")
            rows = [("", "", True, 0) if s == 0 else (names[(s - 1) % 4], "x", False, int(s > 4)) for s in symbols.tolist()]
            assert repair.cheapest_edits(symbols) == plain_best(rows)[:2]


def test_tables_are_small_and_normalised():
    t = repair.tables()
    assert len(t.vectors) < 100 and all(min(v) == 0 for v in t.vectors)
    assert all(len(row) == repair.SYMBOLS**repair.BLOCK for row in t.block_next)


def test_conversations_match_the_plain_way(spark):
    rng = random.Random(7)
    texts = ["Yes.", "no", "", " \t", "a.b", "Why?\n", "é😀!", "...", "\x85", " x. \x0b"]
    roles = ["user", "assistant", "system", "tool", "", "User", "userland"]
    rows = [(c, n, rng.choice(roles), rng.choice(texts)) for c in range(150) for n in range(rng.randint(1, 12))]
    rows += [(200, n, ("user", "assistant")[n % 2], f"turn {n}.") for n in range(300)]  # a hot conversation
    rows += [(201, None, None, None), (201, None, "user", "q."), (201, 5, "assistant", "r."), (201, None, "user", "q.")]
    rows += [(None, n, ("user", "assistant")[n % 2], f"{n}!") for n in range(9)] + [(None, None, "user", "z")]
    rows += [(202, 3, "user", "Again.")] * 40  # repeated rows
    rows += [(203, 1, "user", "word " * 40_000), (203, 2, "assistant", "x" + " " * 200_000)]  # very long texts
    rows += [(203, 9, "assistant", "end."), (203, 9, "assistant", "other end."), (203, 9, "system", "s.")]  # equal turns
    got, want = found(spark, rows), plain(rows)
    assert got == want


def test_conversations_without_rows_after_damage(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(dropped, 0, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_repaired_turns_are_well_formed(spark):
    rng = random.Random(8)
    rows = [(c, n, rng.choice(KINDS)[0], rng.choice(["a.", "b", ""])) for c in range(60) for n in range(7)]
    damaged = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = repair.repaired_turns(damaged, repair.diagnosed(damaged)).collect()
    convs = {}
    for r in sorted(made, key=lambda r: (r.conv_id, r.position)):
        convs.setdefault(r.conv_id, []).append(r)
    assert convs
    for turns in convs.values():
        assert [t.position for t in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(t.role[0] for t in turns))


@pytest.mark.parametrize("audit, rows, lines", [
    ("IK", [("assistant", "x")], [("user", ""), ("assistant", "x")]),
    ("KRI", [("system", "s"), ("tool", "t")], [("system", "s"), ("user", "t"), ("assistant", "")]),
    ("DD", [("user", ""), ("user", "")], []),
])
def test_writer(audit, rows, lines):
    writer = repair.Writer(audit)
    assert [x for r, t in rows for x in writer.turn(r, t)] + list(writer.end()) == lines
