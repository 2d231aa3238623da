"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that ends its encoding.  It is found among the vocabulary
entries that are suffixes of the prefix (an automaton with suffix links reports them, longest first): the one that is
compatible with the token which ends the prefix before it.  Two tokens are compatible if BPE keeps the boundary
between them.  Following the stored tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPECIAL, TwoGenerations, lone_space_parts, per_text, prepare

# The pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PART_CACHE = 250_000
PIECE_CACHE = 100_000
PAIR_CACHE = 2_000_000
CACHED_CHARS = 64  # longer parts and pieces are not kept, so that a cache's bytes are bounded with its entries
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = [""] * 256
    for b in printable:
        symbols[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not symbols[b]):
        symbols[b] = chr(256 + n)
    return symbols


class PrefixBpe:
    """Vocabulary, merge ranks and the suffix automaton of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.pieces = regex.compile(PATTERN).findall
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t != SPECIAL}
        self.special = next((a["id"] for a in spec["added_tokens"] if a["content"] == SPECIAL), None)
        self.rank: dict[tuple[int, int], int] = {}
        self.parents: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[left], vocab[right]
            self.rank[pair] = rank
            self.parents.setdefault(vocab[left + right], (rank, *pair))
        self.length_of = {i: len(b) for i, b in self.bytes_of.items()}
        self._spines: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token in sorted(self.bytes_of, key=lambda t: len(self.bytes_of[t])):
            if self._reachable(token):
                self.automaton.add_word(self.bytes_of[token].decode("latin-1"), token)
        self.automaton.make_automaton()
        self._pairs.clear()
        self._first = TwoGenerations(PART_CACHE // 4)
        self._later = TwoGenerations(PART_CACHE)
        self._pieces = TwoGenerations(PIECE_CACHE)
        self._odd: dict[bytes, bytes] = {}
        self._changed: dict[str, str] = {}

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens at the edge of a token's merge tree, from the single byte up, and the rank that makes each."""
        key = token, side
        if key in self._spines:
            return self._spines[key]
        tokens, ranks = [token], []
        while made := self.parents.get(token):
            ranks.append(made[0])
            token = made[side]
            tokens.append(token)
        self._spines[key] = tokens[::-1], [*ranks[::-1], _NEVER]
        return self._spines[key]

    def _survives(self, left: int, right: int, until: int) -> bool:
        """Whether no merge across the boundary of left + right comes before those of rank `until`."""
        a, when_a = self._spine(left, 2)
        b, when_b = self._spine(right, 1)
        i = j = 0
        while True:
            next_a, next_b = when_a[i], when_b[j]
            across = self.rank.get((a[i], b[j]), _NEVER)
            # Equal ranks merge from the left: first inside `left`, then across, then inside `right`.
            if across < next_a and across <= next_b:
                return across >= until
            if next_a == next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """Whether BPE on the token's own bytes gives the token."""
        made = self.parents.get(token)
        return made is None or self._survives(made[1], made[2], made[0])

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > PAIR_CACHE:
                self._pairs.clear()
            known = self._pairs[key] = self._survives(left, right, _NEVER)
        return known

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The ids of pre-tokenized pieces.  Given in sorted order, a piece reuses the tokens of the prefix it shares."""
        pairs, length_of, find = self._pairs, self.length_of, self.automaton.iter
        last: list[int] = []
        before_piece = b""
        for piece in pieces:
            size = len(piece)
            shared = 0
            if piece[:1] == before_piece[:1]:
                for x, y in zip(piece, before_piece):
                    if x != y:
                        break
                    shared += 1
            before_piece = piece
            last[shared:] = [-1] * (size - shared)
            done = shared - 1
            for end, token in find(piece.decode("latin-1")):
                if end <= done:  # this prefix has its token
                    continue
                start = end - length_of[token]
                if start >= 0:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = pairs.get(before << 20 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
                done = end
            ids = []
            size -= 1
            while size >= 0:
                token = last[size]
                ids.append(token)
                size -= length_of[token]
            yield ids[::-1]

    def _learn(self, cache: TwoGenerations, parts: set[str], lead: str) -> None:
        """Put the parts that are new into `cache`: decimal ids joined by commas.  `_forget` takes long ones out again.

        Each part is also decoded from its ids; one that does not come back as it was is noted with what came back.
        """
        cut = [(part, [p.encode() for p in self.pieces(lead + part)]) for part in cache.missing(parts)]
        known = self._pieces
        new = sorted(known.missing({p for _, pieces in cut for p in pieces}))
        for piece, ids in zip(new, self.encode_pieces(new)):
            known[piece] = b",".join([b"%d" % i for i in ids])
            back = b"".join([self.bytes_of[i] for i in ids])
            if back != piece:
                self._odd[piece] = back
        for part, pieces in cut:
            cache[part] = b",".join([known[p] for p in pieces])
            if self._odd and not self._odd.keys().isdisjoint(pieces):
                self._changed[lead + part] = b"".join([self._odd.get(p, p) for p in pieces]).decode("utf-8", "replace")
        self._forget(known, new)

    @staticmethod
    def _forget(cache: TwoGenerations, keys: Iterable) -> None:
        for key in keys:
            if len(key) > CACHED_CHARS:
                cache.pop(key, None)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(decimal ids joined by commas, text decoded from the ids) of each text."""
        split: list[list[list[str]]] = []
        first: set[str] = set()
        later: set[str] = set()
        for text in texts:
            doc = []
            for stretch in text.split(SPECIAL) if self.special is not None and SPECIAL in text else (text,):
                parts = lone_space_parts(stretch)
                first.add(parts[0])
                later.update(parts[1:])
                doc.append(parts)
            split.append(doc)
        self._learn(self._first, first, "")
        self._learn(self._later, later, " ")
        try:
            yield from self._put_together(split)
        finally:
            self._forget(self._first, first)
            self._forget(self._later, later)

    def _put_together(self, split: list[list[list[str]]]) -> Iterator[tuple[bytes, str]]:
        get, changed = self._later.__getitem__, self._changed
        for doc in split:
            ids: list[bytes] = []
            out: list[str] = []
            for n, parts in enumerate(doc):
                if n:
                    ids.append(b"%d" % self.special)
                    out.append(SPECIAL)
                if head := self._first[parts[0]]:
                    ids.append(head)
                if len(parts) > 1:
                    ids.append(b",".join(map(get, parts[1:])))
                if changed:
                    out.append(changed.get(parts[0], parts[0]) + "".join([changed.get(" " + p, " " + p) for p in parts[1:]]))
                else:
                    out.append(" ".join(parts))
            yield b",".join(ids), "".join(out)

    def encode(self, text: str) -> tuple[bytes, str]:
        (coded,) = self.encode_batch([text])
        return coded


_CODERS: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    """One coder per worker process and file; its caches hold only repeated work."""
    if path not in _CODERS:
        _CODERS[path] = PrefixBpe(path)
    return _CODERS[path]


_CODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ]
)
_DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def _batch(path: str, finish: Callable[[bytes, str], tuple[str, str]], names: list[str]) -> Callable:
    def make() -> Callable[[list[str | None]], pa.Array]:
        encode = coder(path).encode_batch

        def apply(texts: list[str | None]) -> pa.Array:
            counts, a, b = [], [], []
            for ids, decoded in encode([t or "" for t in texts]):
                counts.append(ids.count(b",") + 1 if ids else 0)
                left, right = finish(ids, decoded)
                a.append(left)
                b.append(right)
            return pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names
            )

        return apply

    return make


def encode_decode(text: Column, tokenizer_path: str) -> Column:
    """struct(n_tokens, ids, decoded) of whole texts: ids in decimal, joined by commas, and the text decoded from them.

    Null counts as empty: no tokens, empty ids, empty text.  The string of the special token gives its id, as in the
    tokenizers library.
    """
    return per_text(_batch(tokenizer_path, lambda ids, text: (ids.decode(), text), _CODED.names), _CODED)(text)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, commas) and of the decoded text, one row per input row.

    Digests are taken beside the encoder, so ids do not travel back.  Null text counts as empty; repeated rows and
    null ids give a row each; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def digests(ids: bytes, text: str) -> tuple[str, str]:
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    coded = per_text(_batch(tokenizer_path, digests, _DIGEST.names), _DIGEST)
    return docs.select(F.col("doc_id"), coded(F.col("text")).alias("coded")).select("doc_id", "coded.*")
