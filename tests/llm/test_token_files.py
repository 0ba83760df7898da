"""Token-id files against the tokenizer itself, codes against the plain Huffman cost and the limit."""

import heapq
import io
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from topolake.llm import tokenfile as T

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    """doc_id, start, n_tokens, crc of documents in order, by the library alone."""
    tok, start, out = Tokenizer.from_file(BPE), 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got(T.read_files(T.write_files(docs, BPE))) == plain(rows)


def test_many_files_small_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 64, "EVERY": 8, "FILE_IDS": 500, "FILE_DOCS": 7, "AT_ONCE": 3, "RUN": 2}.items():
        monkeypatch.setattr(T, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = plain(rows)
    # workers import the module afresh, so the small sizes are tried on a file in memory
    raw, n = io.BytesIO(), np.zeros(50257, np.int64)
    ids = [np.array([*Tokenizer.from_file(BPE).encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for _, t in rows]
    for x in ids:
        n += np.bincount(x, minlength=len(n))
    raw.close_, raw.close = raw.close, lambda: None
    w = T.FileWriter(raw, T.code_lengths(n, 18), 18)
    for (d, _), x in zip(rows, ids, strict=True):
        w.add(d, x)
    n_docs, n_blocks, total = w.close()
    r = T.FileReader(pa.BufferReader(raw.getvalue()))
    assert (n_docs, total) == (len(rows), sum(map(len, ids)))
    found = [x for k in range(0, n_blocks, 2) for x in r.documents(k, 2)]
    assert found == want
    whole = np.concatenate(ids)
    for start, size in ((0, 1), (63, 2), (64, 64), (100, 777), (total - 3, 3), (5, 0)):
        assert r.ids(start, size).tolist() == whole[start : start + size].tolist()
    damaged = bytearray(raw.getvalue())
    damaged[-60] ^= 1
    with pytest.raises(ValueError):
        T.FileReader(pa.BufferReader(bytes(damaged)))


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = got(T.read_files(T.write_files(odd, BPE)))
    crc = {k: [] for k, _ in rows}
    for d, t in rows:
        crc[d].append(plain([(d, t)])[0][2:])
    assert [r[0] for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert {d: sorted(x[2:] for x in found if x[0] == d) for d in crc} == {d: sorted(x) for d, x in crc.items()}
    ends = [r[1] + r[2] for r in found]
    assert [r[1] for r in found] == [0, *ends[:-1]]


def test_empty_table_and_empty_texts(spark, none):
    assert T.read_files(T.write_files(none, BPE)).count() == 0
    blank = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    assert got(T.read_files(T.write_files(blank, BPE))) == plain([(i, None) for i in range(5)])


def test_control_strings_by_default_and_as_text(spark):
    text = "one <|endoftext|> two"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert got(T.read_files(T.write_files(docs, BPE))) == plain([(1, text)])
    assert got(T.read_files(T.write_files(docs, BPE, specials_as_text=True)))[0][2] > plain([(1, text)])[0][2]


def test_other_tokenizers_get_whole_texts(spark):
    path, docs = public_tokenizers.path("word_bpe_49k.json"), spark.createDataFrame([(1, "Some Words, here.\n\nAnd  more"), (2, None)], "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in ("Some Words, here.\n\nAnd  more", "")]
    assert [(r[2], r[3]) for r in got(T.read_files(T.write_files(docs, path)))] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]


def test_hot_id_over_several_tasks(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('same words here ', cast(id % 3 as string)) as text")
    found = got(T.read_files(T.write_files(docs, BPE, per_task=2000)))
    assert len(found) == 3000 and len({r[1] for r in found}) == 3000
    assert len({r[3] for r in found}) == 3


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@pytest.mark.parametrize("seed", range(4))
def test_lengths(seed):
    r = np.random.default_rng(seed)
    counts = r.zipf(1.3, 300).clip(max=10**9) * r.integers(0, 2, 300)
    free = T.code_lengths(counts, 40)
    assert (free * counts).sum() == huffman_cost(counts)
    for limit in (9, 10, 12):
        lengths = T.code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
        assert (lengths * counts).sum() >= (free * counts).sum()
        codes, _ = T.canonical(lengths)
        words = {f"{int(codes[i]):0{lengths[i]}b}" for i in lengths.nonzero()[0]}
        assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_limited_lengths_are_the_cheapest():
    counts = np.array([1, 1, 2, 3, 5, 8])
    lengths = T.code_lengths(counts, 3)
    best = min(
        sum(c * x for c, x in zip(counts, ls, strict=True))
        for ls in np.ndindex(*(3,) * 6)
        for ls in [tuple(x + 1 for x in ls)]
        if sum(2.0**-x for x in ls) <= 1
    )
    assert (lengths * counts).sum() == best


ODD_TEXTS = [
    "", " ", "\n", "  ", " a", "a ", "\na", "a\n", "\n\na\n\n", "a  b", "a   b", "a \n b", "a\n \nb", "a\t b\t\tc \td", "\ta", "a\x1c b \x1c c", ".\x1c.", "a\u3000b \u3000 c",
    "it's we're 'll x", "don 't", "12 34,5 6", "ä ö\nü é", "日本 語\n\n日", "x" * 2000, " ".join("ab" * (i % 9) for i in range(3000)), "<|endoftext|>", "a <|endoftext|> b<|endoftext|>\nc", "a\r\nb\r\n", "a \u0301b", "\x85a \x85 b", "e\x00 \x00f", "  \n x  \n", "a , b", "a. .b", "3.14,15 (x).y_,z ..a,,b", " ,a", " .", ".a\n,b", "ñ.é,ü",
]


@pytest.mark.parametrize("as_text", [False, True])
def test_chunks_give_the_ids_of_whole_texts(as_text):
    tok, own = Tokenizer.from_file(BPE), T.Encoder(BPE, as_text)
    tok.encode_special_tokens = as_text
    want = [tok.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(ODD_TEXTS)] == want
    for t, ids in zip(ODD_TEXTS, want, strict=True):
        assert own.encode([t])[0].tolist() == ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sté1.,-_ \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000日²<|>"), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    tok = _tokenizer()
    assert [x.tolist() for x in _encoder().encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


_tokenizer, _encoder = lru_cache(lambda: Tokenizer.from_file(BPE)), lru_cache(lambda: T.Encoder(BPE, False))
