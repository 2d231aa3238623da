"""Sum-of-squares online packing of token ids into windows of a fixed capacity."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import SPECIAL, lone_space_parts, prepare

CAPACITY = 1024
CACHE_ENTRIES = 400_000
MAX_OPEN = 4096
_MARKS = ".,;:!?$*&%#|)\""
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class _Known(dict):
    """Ids of parts (with `lead` in front), asked of the tokenizer when new; two generations bound its size.

    The pre-tokenizer always cuts between letters and marks, never between letters, and on both sides of a line end
    that stands between two other characters.  So a new part is put together from words, marks and lines that may be
    known: `tails` has the marks and `first` the parts at the start of a line.
    """

    def __init__(self, encode: Callable[[str], bytes], word: Callable[[str], bytes], lead: str, tails: _Known | None = None) -> None:
        super().__init__()
        self.encode, self.word, self.lead, self.tails = encode, word, lead, tails
        self.first: _Known = self
        self.line_end = encode("\n")
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            stem = part.rstrip(_MARKS) if self.tails is not None else part
            if stem.isalpha():
                ids = self.word(self.lead + part) if len(stem) == len(part) else self[stem] + self.tails[part[len(stem) :]]
            elif "\n" in part and (lines := part.split("\n")) == part.split():
                first = self.first
                return self.line_end.join([self[lines[0]], *(first[line] for line in lines[1:])])
            else:
                ids = self.encode(self.lead + part)
        if len(part) <= 64:
            self[part] = ids
        return ids

    def trim(self, entries: int) -> None:
        if len(self) > entries:
            self.older = dict(self)
            self.clear()


class SegmentIds:
    """Ids (unsigned 32-bit numbers as bytes) of texts, by the tokenizers library.

    Words repeat, so the ids of each distinct part between lone spaces are kept in a bounded cache; only new parts
    reach the tokenizer.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.no_truncation()
        tok.no_padding()
        special = tok.token_to_id(SPECIAL)
        self.special = None if special is None else array("I", [special]).tobytes()

        def encode(text: str) -> bytes:
            return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

        tokenize, symbols = tok.model.tokenize, byte_symbols()
        blank, symbol_of = symbols[32], dict(enumerate(symbols))

        def word(text: str) -> bytes:
            """The ids of letters, with or without a space in front: one piece, so the BPE model alone does."""
            if text.isascii():  # letters stand for themselves
                text = blank + text[1:] if text[0] == " " else text
            else:
                text = text.encode().decode("latin-1").translate(symbol_of)
            return array("I", [t.id for t in tokenize(text)]).tobytes()

        self.tails = _Known(encode, word, "")
        self.first = _Known(encode, word, "", self.tails)
        self.later = _Known(encode, word, " ", self.tails)
        self.later.first = self.first

    def batch(self, texts: list[str]) -> list[bytes]:
        self.later.trim(CACHE_ENTRIES)
        self.first.trim(CACHE_ENTRIES // 4)
        self.tails.trim(CACHE_ENTRIES // 4)
        first, later, out = self.first, self.later.__getitem__, []
        for text in texts:
            pieces = []
            for stretch in text.split(SPECIAL) if self.special is not None and SPECIAL in text else (text,):
                parts = lone_space_parts(stretch)
                pieces.append(first[parts[0]] + b"".join(map(later, parts[1:])))
            out.append(pieces[0] if len(pieces) == 1 else self.special.join(pieces))
        return out


_CODERS: dict[str, SegmentIds] = {}


def coder(path: str) -> SegmentIds:
    """One per worker process and file, so that tasks find the words that earlier ones have met."""
    if path not in _CODERS:
        _CODERS[path] = SegmentIds(path)
    return _CODERS[path]


class SumOfSquares:
    """Places items into windows so that the sum over levels of (open windows at that level)² stays smallest.

    `level[h]` counts the open windows filled to h.  Moving one window from h to h + s, or opening one at s, changes
    the sum by an amount that `level` alone gives; a window that becomes full leaves the sum.  Ties go to the fullest
    window.  An item is a list of pieces (doc, start, ids); windows come out once they are full.  When more than
    `max_open` windows are open, and at the end, the open windows are cut into full ones, so that only the last one
    of a task is padded.
    """

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> None:
        self.capacity = capacity
        self.max_open = max_open
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(capacity)]
        self.open = 0

    def choose(self, size: int) -> int:
        """The level to place an item of `size` (below capacity) at; 0 opens a window."""
        last = self.capacity - size
        here = self.level[: last + 1]
        change = 2 * (self.level[size : self.capacity + 1] - here) + 2
        change[last] = 1 - 2 * here[last]
        change[here == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.level[size] + 1
        return last - int(np.argmin(change[::-1]))

    def add(self, piece: tuple, size: int) -> Iterator[list[tuple]]:
        at = self.choose(size)
        window = []
        if at:
            window = self.windows[at].pop()
            self.level[at] -= 1
            self.open -= 1
        window.append(piece)
        if at + size == self.capacity:
            yield window
            return
        self.windows[at + size].append(window)
        self.level[at + size] += 1
        self.open += 1
        if self.open > self.max_open:
            yield from self.drain(last=False)

    def drain(self, last: bool = True) -> Iterator[list[tuple]]:
        """Cut the open windows, emptiest first, into full ones; what is left stays open, or comes out if `last`."""
        pieces = [p for at in range(1, self.capacity) for w in self.windows[at] for p in w]
        self.level[:] = 0
        self.windows = [[] for _ in range(self.capacity)]
        self.open = 0
        window: list[tuple] = []
        room = self.capacity
        for doc, start, ids in pieces:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, part))
                start += len(part) // 4
                room -= len(part) // 4
                if room == 0:
                    yield window
                    window, room = [], self.capacity
        if window and last:
            yield window
        elif window:
            self.windows[self.capacity - room].append(window)
            self.level[self.capacity - room] += 1
            self.open = 1


def pack_stream(docs: Iterable[tuple[int | None, bytes]], first_sequence: int, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, id bytes) in the order given; sequence ids count from `first_sequence`."""
    packer = SumOfSquares(capacity, max_open)
    sequence = first_sequence
    width = 4 * capacity

    def rows(window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for (doc_id, total), start, ids in window:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset
            offset += len(ids) // 4

    for doc_id, ids in docs:
        doc = (doc_id, len(ids) // 4)
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            yield from rows([(doc, at // 4, ids[at : at + width])])
            sequence += 1
        if rest := ids[whole:]:
            for window in packer.add((doc, whole // 4, rest), len(rest) // 4):
                yield from rows(window)
                sequence += 1
    for window in packer.drain():
        yield from rows(window)
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece of a document in a packed sequence (columns of SCHEMA).

    Every document becomes its token ids and the id 0; null text counts as empty, so every row gives at least that
    id.  A document's full windows are sequences of their own and its rest is placed by SumOfSquares.  Each input
    partition is packed by itself, in row order and without a shuffle, so a lost task gives the same rows again;
    ids of sequences are (partition << 40) + count.  Repeated rows are packed as often as they come; null doc_id
    stays null; other columns are not read; an empty table gives no rows.  A task holds at most `max_open` open
    windows and one batch of texts.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment_ids = coder(tokenizer_path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        end = b"\0\0\0\0"

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), segment_ids.batch(texts)):
                    yield doc_id, ids + end

        chunk: list[tuple] = []
        for row in pack_stream(documents(), TaskContext.get().partitionId() << 40, capacity, max_open):
            chunk.append(row)
            if len(chunk) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk)], names=names)
                chunk = []
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)
