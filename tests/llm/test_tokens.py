import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatewright.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, coded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    rng = random.Random(4)
    chars = [chr(c) for c in (*range(0x250), *range(0x370, 0x400), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600)]
    words = ["the ", "  ", "\n\n ", "ha", "'s", "1", "aaa", "=", " <|endoftext|>", "<|endo"]
    return [
        "".join(rng.choice(chars) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)
    ]


def test_bpe_matches_the_library(library):
    texts = [*odd_texts(3000), "", " ", "a" * 500, "ab" * 900, "<|endoftext|>" * 3]
    coder = bpe.PrefixBpe(PATH)
    for text, (ids, decoded) in zip(texts, coder.encode_batch(texts)):
        own = library.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, own))
        assert decoded == library.decode(own, skip_special_tokens=False) == text


def test_bpe_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CACHE", 3)
    monkeypatch.setattr(bpe, "PIECE_CACHE", 3)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 3)
    coder = bpe.PrefixBpe(PATH)
    for text in odd_texts(200):
        assert coder.encode(text)[0].decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_bpe_caches_hold_short_texts_only(library):
    coder, rng = bpe.PrefixBpe(PATH), random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) for _ in range(60)] + ["x" * 70 + " " + "y" * 65 + " z"]
    for text, (ids, decoded) in zip(texts, coder.encode_batch(texts)):
        assert ids.decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids)) and decoded == text
    assert all(len(k) <= bpe.CACHED_CHARS for c in (coder._first, coder._later, coder._pieces) for k in c)
    long = "long text, 中文 " * 40_000
    assert coder.encode(long)[0].count(b",") + 1 == len(library.encode(long, add_special_tokens=False).ids)


def test_bpe_rows(spark, library):
    rows = [(1, "one two", "x", "y"), (1, "one two", "x", "y"), (None, "z", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")]
    got = bpe.encode_digests(spark.createDataFrame(rows, DOCS), PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode_digests(spark.createDataFrame([], DOCS), PATH).count() == 0


def check_pieces(rows, docs, library, capacity):
    at_doc, at_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, seq, offset in rows:
        ids = library.encode(docs[doc] or "", add_special_tokens=False).ids + [0]
        assert total == len(ids) and length > 0
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        at_doc[doc].append((start, length))
        at_seq[seq].append((offset, length))
    assert set(at_doc) == set(docs)
    for parts in [*at_doc.values(), *at_seq.values()]:  # gapless, each id once
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
    for doc, parts in at_doc.items():
        assert sum(n for _, n in parts) == len(library.encode(docs[doc] or "", add_special_tokens=False).ids) + 1
    sizes = [sum(n for _, n in parts) for parts in at_seq.values()]
    assert max(sizes) <= capacity
    return sizes


def test_packing_holds_every_id_once(spark, library):
    rng = random.Random(5)
    docs = {i: " ".join(rng.choices(["alpha", "beta,", "x!!", "y z", "z.1)", "<|endoftext|>", "it's\"", "*"], k=rng.choice([0, 1, 5, 60, 700]))) for i in range(300)}
    docs[300], docs[301] = None, "word " * 5000
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], DOCS).repartition(3)
    rows = [tuple(r) for r in packing.pack_documents(frame, PATH).collect()]
    sizes = check_pieces(rows, docs, library, 1024)
    assert sum(s < 1024 for s in sizes) <= 3  # the last window of a task
    rows = [tuple(r) for r in packing.pack_documents(frame, PATH, capacity=64, max_open=2).collect()]
    check_pieces(rows, docs, library, 64)


def test_segment_ids_match_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 30)
    rng = random.Random(8)
    marks = ["\n", "\n\n", "\t", " ", "  ", ". ", ".\n", "!)\n", "\x1c", "\x85", "'s", " <|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(["word", "Été", "中文", "a1", "X"]) + rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += odd_texts(2000)
    coder = packing.SegmentIds(PATH)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], coder.batch(texts[at : at + 100])):
            assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_edges(spark):
    same = spark.createDataFrame([(1, "a", "", "")] * 3 + [(None, None, "", "")], DOCS).coalesce(1)
    rows = packing.pack_documents(same, PATH).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows) == [(0, 1), (1, 2), (1, 2), (1, 2)]
    assert len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_sum_of_squares_choice():
    """The level chosen leaves the smallest sum of squared counts over the partly filled levels."""
    rng = random.Random(6)
    packer = packing.SumOfSquares(capacity=20)
    for n in range(2000):
        size = rng.randint(1, 19)
        sums = {}
        for at in range(20 - size + 1):
            if at and not packer.level[at]:
                continue
            after = packer.level.copy()
            after[at] -= 1 if at else 0
            after[at + size] += 1
            sums[at] = int((after[1:20] ** 2).sum())
        assert sums[packer.choose(size)] == min(sums.values())
        for _ in packer.add(((n, size), 0, b"\0\0\0\0" * size), size):
            pass
