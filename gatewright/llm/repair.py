"""Conversation structure repair: the cheapest edits to a well-formed role sequence, by Four-Russians block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import prepare

DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1  # costs; keeping a turn costs nothing
BLOCK = 4  # symbols looked up at once
WHITE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")

# What has been written so far: nothing, a system turn, ... a user turn, ... an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = (USER, USER, ASSISTANT, USER)  # only one of the two roles fits behind each state
ACCEPTED = (START, ASSISTANT)

# A turn's class is its role's initial; its symbol adds what is wrong with it.
CLASSES = "sua"  # any other initial is class 3
GONE = 0  # blank or duplicate: must be deleted; 1-4 complete, 5-8 truncated, by class
SYMBOLS = 9
_FAR = 1 << 30


def _kept(state: int, kind: int) -> int | None:
    """The state after a turn of class `kind` is kept behind `state`; None where that breaks the order of roles."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def _step(rest: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cheapest costs from each state before a turn, from those behind it."""
    best = [DELETE + rest[q] for q in range(4)]
    if symbol != GONE:
        extra, kind = (UNFINISHED if symbol > 4 else 0), (symbol - 1) % 4
        for q in range(4):
            best[q] = min(best[q], REROLE + extra + rest[AFTER_INSERT[q]])
            to = _kept(q, kind)
            if to is not None:
                best[q] = min(best[q], extra + rest[to])
    for _ in range(2):  # two insertions reach every state that insertions can reach
        best = [min(best[q], INSERT + best[AFTER_INSERT[q]]) for q in range(4)]
    return tuple(best)


class Tables:
    """Transitions of normalised cost vectors (smallest entry 0) for one symbol and for every block of BLOCK symbols.

    Costs run from the end of a conversation to its start, so a block's transition leads from the vector behind it to
    the vector before it, and a table has a row for each vector that can occur and a column for each block.
    """

    def __init__(self) -> None:
        end = [0 if q in ACCEPTED else _FAR for q in range(4)]
        for _ in range(2):
            end = [min(end[q], INSERT + end[AFTER_INSERT[q]]) for q in range(4)]
        self.vectors = [tuple(end)]
        number = {self.vectors[0]: 0}
        rows = []
        for vector in self.vectors:  # grows while new vectors turn up
            row = []
            for symbol in range(SYMBOLS):
                new = _step(vector, symbol)
                low = min(new)
                new = tuple(x - low for x in new)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((number[new], low))
            rows.append(row)
        one = np.array(rows, np.int32)
        self.next, self.cost = one[:, :, 0], one[:, :, 1]
        many, cost = np.arange(len(self.vectors), dtype=np.int32)[:, None], np.zeros((len(self.vectors), 1), np.int32)
        for _ in range(BLOCK):  # one symbol more in front of each block
            many, cost = (
                self.next[many].transpose(0, 2, 1).reshape(len(self.vectors), -1),
                (cost[:, :, None] + self.cost[many]).transpose(0, 2, 1).reshape(len(self.vectors), -1),
            )
        self.block_next, self.block_cost = many.tolist(), cost.tolist()
        self.next, self.cost = self.next.tolist(), self.cost.tolist()
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expand(self, vector: int, symbols: tuple[int, ...], state: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits of these symbols from `state`, if `vector` holds behind them; the state then."""
        behind = [vector]
        for symbol in reversed(symbols):
            behind.append(self.next[behind[-1]][symbol])
        edits = []
        for at, symbol in enumerate(symbols):
            rest = self.vectors[behind[len(symbols) - at - 1]]
            due = _step(rest, symbol)
            extra, kind = (UNFINISHED if symbol > 4 else 0), (symbol - 1) % 4
            while True:  # D, I, K, R: the least initial that is still cheapest
                if due[state] == DELETE + rest[state]:
                    edits.append("D")
                    break
                if due[state] == INSERT + due[AFTER_INSERT[state]]:
                    edits.append("I")
                    state = AFTER_INSERT[state]
                    continue
                to = _kept(state, kind)
                if to is not None and due[state] == extra + rest[to]:
                    edits.append("K")
                    state = to
                else:
                    edits.append("R")
                    state = AFTER_INSERT[state]
                break
        return "".join(edits), state

    def block(self, vector: int, code: int, state: int) -> tuple[str, int]:
        """`expand` of a whole block, looked up once it has been expanded."""
        key = (vector, code, state)
        found = self.traced.get(key)
        if found is None:
            symbols = tuple(code // SYMBOLS ** (BLOCK - 1 - n) % SYMBOLS for n in range(BLOCK))
            found = self.traced[key] = self.expand(vector, symbols, state)
        return found


@cache
def tables() -> Tables:
    return Tables()


def cheapest_edits(symbols: np.ndarray) -> tuple[int, str]:
    """The least cost of a conversation given as symbols, and its edits (D, I, K, R); of equal costs the ASCII-least.

    Whole blocks are looked up from the last to the first, keeping the number of the vector behind each.  The trace
    expands them in the opposite direction, where a choice between equal costs is a choice of the next edit's initial.
    """
    t = tables()
    head = len(symbols) % BLOCK
    lead = tuple(symbols[:head].tolist())
    codes = symbols[head:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    codes = codes.tolist()
    vector, total, behind = 0, 0, []
    for code in reversed(codes):
        behind.append(vector)
        total += t.block_cost[vector][code]
        vector = t.block_next[vector][code]
    before_blocks = vector
    for symbol in reversed(lead):
        total += t.cost[vector][symbol]
        vector = t.next[vector][symbol]
    total += t.vectors[vector][START]
    edits, state = t.expand(before_blocks, lead, START)
    parts = [edits]
    for code in codes:
        edits, state = t.block(behind.pop(), code, state)
        parts.append(edits)
    while state not in ACCEPTED:
        parts.append("I")
        state = AFTER_INSERT[state]
    return total, "".join(parts)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage that crc32(`conv_id:turn`) % 20 picks.

    Null roles and texts, and null ids in the hashed key, are one space.  A dropped row has 0 copies, so that its
    conversation stays known; a repeated row has 2.
    """

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    read = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    return read.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def observed(turns: DataFrame) -> DataFrame:
    """One row for each distinct turn of turns(conv_id, turn, role, text, copies), with its faults but without its text.

    conv_id, turn, role, digest (of role and text), kind (the class), blank, truncated, copies, first (whether the role
    and text were not seen earlier in the conversation).  Equal rows are counted before they travel.
    """
    bare = F.rtrim("text", F.lit(WHITE))
    last = F.substring(bare, -1, 1)
    initial = F.substring("role", 1, 1)
    facts = turns.select(
        "conv_id",
        "turn",
        "role",
        row_digest().alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
        (bare == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
        "copies",
    )
    rows = facts.groupBy("conv_id", "turn", "role", "digest", "kind", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    seen = (
        rows.where("copies > 0")
        .groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
        .agg(F.min(F.struct("turn"))["turn"].alias("since"))
    )
    joined = rows.join(seen, rows["conv_id"].eqNullSafe(seen["c"]) & (rows["digest"] == seen["d"]), "left")
    return joined.select(*rows.columns, F.col("turn").eqNullSafe(F.col("since")).alias("first"))


def row_digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


_ORDER = ("turn", "role", "digest")  # within a conversation; null turns come first
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values; null equals null."""
    at = 0
    for n in range(1, len(keys) + 1):
        if n == len(keys) or keys[n] != keys[at]:
            yield at, n
            at = n


class _Conversation:
    """What is kept of a conversation while its rows stream by: two small numbers for each turn."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.low = self.high = None
        self.kinds: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []

    def add(self, turn: list, kind: np.ndarray, blank: np.ndarray, truncated: np.ndarray, copies: np.ndarray, first: np.ndarray) -> None:
        held = copies > 0
        single = np.where(held & ~blank & first, 1, 0)  # of the copies of a turn, the first is not a duplicate
        self.blank += int(copies[blank].sum())
        self.duplicate += int((copies - single)[~blank].sum())
        self.truncated += int(single[truncated].sum())
        for value, there in zip(turn, held.tolist()):
            if there and value is not None and value != self.high:  # in ascending order
                self.low = value if self.low is None else self.low
                self.high = value
                self.turns += 1
        self.kinds.append(np.repeat(kind, copies))
        good = 1 + kind + 4 * truncated
        self.symbols.append(np.repeat(np.stack([good, np.full_like(good, GONE)], 1).ravel(), np.stack([single, copies - single], 1).ravel()))

    def verdict(self) -> tuple:
        kinds = np.concatenate(self.kinds)
        a, b = kinds[:-1], kinds[1:]
        legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        cost, audit = cheapest_edits(np.concatenate(self.symbols).astype(np.int64))
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, int((~legal).sum()), cost, audit


def diagnosed(turns: DataFrame) -> DataFrame:
    """One row for each conversation of turns(conv_id, turn, role, text, copies): its counts, cost and audit.

    The rows of a conversation stream through one task in order, without their texts; a turn costs it two bytes.
    """
    rows = observed(turns)
    schema = _result(rows, _COUNTS, ["audit"])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            ids, turn = batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist()
            kind = batch.column("kind").to_numpy().astype(np.int8)
            blank, truncated, first = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("blank", "truncated", "first"))
            copies = batch.column("copies").to_numpy()
            done = []
            for a, b in _runs(ids):
                if now is None or now.conv_id != ids[a]:
                    if now is not None:
                        done.append(now.verdict())
                    now = _Conversation(ids[a])
                now.add(turn[a:b], kind[a:b], blank[a:b], truncated[a:b], copies[a:b], first[a:b])
            if done:
                yield _batch(done, arrow)
        if now is not None:
            yield _batch([now.verdict()], arrow)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return ordered.select("conv_id", "turn", "kind", "blank", "truncated", "copies", "first").mapInArrow(fold, schema)


def _result(df: DataFrame, longs: list[str], strings: list[str]) -> T.StructType:
    """conv_id as `df` has it, then columns of longs and of strings."""
    own = T.StructField("conv_id", df.schema["conv_id"].dataType)
    return T.StructType([own, *(T.StructField(n, T.LongType()) for n in longs), *(T.StructField(n, T.StringType()) for n in strings)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Writer:
    """Applies an audit to the turns of a conversation as they pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = AFTER_INSERT[self.state]
            yield ROLES[self.state - USER], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired turns that a turn becomes, those inserted before it included."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _kept(self.state, CLASSES.index(role[0]))
            yield role, text
        elif edit == "R":
            self.state = AFTER_INSERT[self.state]
            yield ROLES[self.state - USER], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def repaired_turns(turns: DataFrame, verdicts: DataFrame, digests: bool = False) -> DataFrame:
    """The turns after repair: conv_id, position (from 0), role, text.

    With `digests` one row for each conversation instead: the verdict's columns and repaired_sha256, of the lines
    `role:text` joined by newlines.  The audit of a conversation goes ahead of its turns in one sorted stream, so a
    task holds an audit and a batch of turns, never the texts of a conversation.
    """
    schema = _result(turns, _COUNTS, ["audit", "repaired_sha256"]) if digests else _result(turns, ["position"], ["role", "text"])
    arrow = to_arrow_schema(schema)
    heads = verdicts.select("conv_id", F.struct(*_COUNTS, "audit").alias("verdict"))
    rows = turns.where("copies > 0").withColumn("digest", row_digest())
    stream = heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    # The head has no text and no digest; null digests sort first, behind it come null turns.
    stream = stream.withColumn("body", F.col("digest").isNotNull()).sortWithinPartitions("conv_id", "body", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = writer = sha = None
        conv_id, position, out = None, 0, []

        def put(made: Iterator[tuple[str, str]]) -> None:
            nonlocal position
            for role, text in made:
                if digests:
                    sha.update((f"\n{role}:{text}" if position else f"{role}:{text}").encode("utf-8", "surrogatepass"))
                else:
                    out.append((conv_id, position, role, text))
                position += 1

        def close() -> None:
            if writer is not None:
                put(writer.end())
                if digests:
                    out.append((conv_id, *verdict.values(), sha.hexdigest()))

        for batch in batches:
            for c, found, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "verdict", "role", "text", "copies"))):
                if found is not None:
                    close()
                    conv_id, verdict, writer, sha, position = c, found, Writer(found["audit"]), hashlib.sha256(), 0
                else:
                    for _ in range(copies):
                        put(writer.turn(role, text))
            if out:
                yield _batch(out, arrow)
                out = []
        close()
        if out:
            yield _batch(out, arrow)

    return stream.select("conv_id", "verdict", "role", "text", "copies").mapInArrow(run, schema)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged.

    A conversation's rows after damage go by turn (nulls first), equal turns by role and then by digest.  A row is
    blank without a character other than white space, a duplicate if its role and text were seen earlier, truncated if
    its last such character is none of `.!?`; the first of these counts.  Keeping costs 0, a new role (user or
    assistant) 2, deletion 3 and is a must for blank and duplicate rows, an inserted empty turn 2, a truncated row that
    stays 1 more.  `audit` has the initials of the cheapest edits that lead to an optional system turn and pairs of
    user and assistant, `illegal` the neighbours before repair that are none of su, ua, au.

    Null roles and texts are one space; a null conv_id is a conversation of its own; repeated rows are duplicates;
    a conversation whose rows are all dropped has zeros, an empty audit and the digest of an empty string; an empty
    table gives no rows; other columns are not read.  SHA-256 reads a text from its start to its end, so the rows of
    one conversation pass through one task, as a sorted stream that is never held.
    """
    prepare(turns.sparkSession)
    rows = damaged(turns)
    return repaired_turns(rows, diagnosed(rows), digests=True)
