"""Substring dedup by line and segment hashing.

Units are lines and pairs of neighbouring segments. Words are lower-cased; a segment ends after a word whose hash with the
word before it is divisible by `segment`, so the same passage is cut at the same words wherever it stands, in the middle of a
line or broken into lines elsewhere; without such a word for LONGEST x `segment` words it ends there. Every unit's digest of
128 bits is grouped over all documents, the occurrence of the earliest rank (doc_id, then the text's hash, then the place in
the text) stays, and later ones are marked. Marked units that overlap make a run; runs of `run_words` words or more are
removed. A pair stands for two segments that also stood together where they come from, so short pieces from different places
make no run, and a short line that many texts share is left alone unless it is part of more; `line_words` and `run_words` of
1 take every repeated line. A run reaches from cut to cut or from line end to line end: the words of a passage before its
first cut and after its last one stay. What remains keeps its characters; the removed spans are given as offsets into the
original.

Within a batch of documents only the first occurrence of a digest goes on to the shuffle, the later ones are marked at
once, so a line that a third of all rows share costs one row a batch.

Defined results: a null text stays null, with no spans; an empty text has no units; rows that agree in doc_id and text are
the same occurrence and get the same result; rows with one doc_id and different texts rank by the text's hash; a null
doc_id ranks last; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .util import fresh, own, shared_dir, trim

SEGMENT, RUN_WORDS, LINE_WORDS = 5, 20, 5
#: Without a cut for so many times `segment` words one is forced; a word repeated over and over then makes equal segments.
LONGEST = 5
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LINE = np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Units that one batch gathers before it is cleared of repeats.
HELD = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def cuts(word: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of each segment of a text, by its words' hashes."""
    n = len(word)
    with np.errstate(over="ignore"):
        cut = _mix(word * np.uint64(3) + np.r_[np.uint64(0), word[:-1]]) % np.uint64(segment) == 0
    cut[-1] = True
    ends = np.nonzero(cut)[0]
    gaps = np.diff(np.r_[-1, ends])
    for i in np.nonzero(gaps > LONGEST * segment)[0]:
        cut[np.arange(ends[i] - gaps[i] + LONGEST * segment, ends[i], LONGEST * segment)] = True
    first = np.r_[0, np.nonzero(cut)[0] + 1][:-1]
    return first, np.diff(np.r_[first, n])


def units(text: str, segment: int = SEGMENT, line_words: int = LINE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, check, first word, words) per unit: all pairs of neighbouring segments, then lines of `line_words` or more.

    digest and check are two hashes of the same words, 64 bits each.
    """
    lines = [x.split() for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    lens = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    lens = lens[lens > 0]
    n = int(lens.sum())
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lines)), np.uint64, n)
    first, size = cuts(word, segment)
    line_at = np.r_[0, np.cumsum(lens)[:-1]]
    long = lens >= line_words
    out = []
    with np.errstate(over="ignore"):
        for step in _STEP:
            def digest(at: np.ndarray, of: np.ndarray, step=step) -> np.ndarray:
                place = (np.arange(n) - np.repeat(at, of)).astype(np.uint64)
                return _mix(np.add.reduceat(_mix(word ^ (place * step)), at) + of.astype(np.uint64))

            seg = digest(first, size)
            out.append(np.r_[_mix(_mix(seg[:-1] ^ step) + seg[1:]), (digest(line_at, lens) ^ _LINE)[long]])
    return *out, np.r_[first[:-1], line_at[long]], np.r_[size[:-1] + size[1:], lens[long]]


def spans(text: str, marked: set[int], segment: int = SEGMENT, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> list[tuple[int, int]]:
    """(start, end) of what is removed from a text whose units in `marked` repeat earlier ones."""
    _, _, first, size = units(text, segment, line_words)
    some = sorted((int(first[i]), int(first[i] + size[i])) for i in marked)
    runs: list[list[int]] = []
    for a, b in some:  # units that overlap belong together, those that only touch don't
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    runs = [r for r in runs if r[1] - r[0] >= run_words]
    if not runs:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = lambda i: i == 0 or "\n" in text[words[i - 1][1] : words[i][0]]
    out: list[tuple[int, int]] = []
    for a, b in runs:
        end = words[b - 1][1]
        if starts(a) and (b == len(words) or starts(b)):  # whole lines go with their breaks
            end = words[b][0] if b < len(words) else len(text)
        while end < len(text) and text[end] in " \t":
            end += 1
        if out and out[-1][1] >= words[a][0]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((words[a][0], end))
    return out


def marks(docs: DataFrame, segment: int = SEGMENT, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, thash, units): ordinals of the units of each text that have an earlier occurrence somewhere."""
    spark = docs.sparkSession
    keyed = own(docs, "doc_id", "text").where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    names = ["digest", "chk", "doc_id", "thash", "ord", "done"]

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            digest, chk, doc, thash, ord_ = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ord_, thash, doc, chk, digest))
            digest, chk, doc, thash, ord_ = (x[order] for x in (digest, chk, doc, thash, ord_))
            same = np.r_[False, (digest[1:] == digest[:-1]) & (chk[1:] == chk[:-1])]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(digest))))
            repeated = same & ~((doc == doc[start]) & (thash == thash[start]) & (ord_ == ord_[start]))
            with np.errstate(over="ignore"):  # what is known to repeat is dealt out evenly
                spread = _mix((doc ^ thash).view(np.uint64) + ord_.astype(np.uint64) * _STEP[0]).view(np.int64)
            cols = (np.where(repeated, spread, digest), np.where(repeated, 0, chk), doc, thash, ord_, repeated)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names)

        for b in it:
            for doc, thash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                digest, chk, first, _ = units(text.as_py(), segment, line_words)
                if n := len(first):
                    held.append((digest.view(np.int64), chk.view(np.int64), np.full(n, doc), np.full(n, thash), np.arange(n, dtype=np.int32)))
                    count += n
                if count >= HELD:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()
            held = []
        trim()

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by done, digests and rank: done ones repeat, and so does any but a digest's first; streamed."""
        last = None
        for b in it:
            digest, chk, doc, thash, ord_, done = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(digest):
                continue
            new = np.r_[last is None or (digest[0], chk[0]) != last[:2], (digest[1:] != digest[:-1]) | (chk[1:] != chk[:-1])]
            at = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
            head = [np.where(at >= 0, x[at], last[i] if last else 0) for i, x in ((2, doc), (3, thash), (4, ord_))]
            late = done | ~((doc == head[0]) & (thash == head[1]) & (ord_ == head[2]))
            last = (digest[-1], chk[-1], head[0][-1], head[1][-1], head[2][-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[late]) for x in (doc, thash, ord_)], ["doc_id", "thash", "ord"])

    shared_dir(spark)
    cols = "digest long, chk long, doc_id long, thash long, ord int, done boolean"
    dealt = keyed.mapInArrow(emit, cols).repartition("digest").sortWithinPartitions("done", "digest", "chk", "doc_id", "thash", "ord")
    return dealt.mapInArrow(settle, "doc_id long, thash long, ord int").groupBy("doc_id", "thash").agg(F.collect_set("ord").alias("_units"))


def remove_repeats(docs: DataFrame, segment: int = SEGMENT, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS, removed_as: str = "removed") -> DataFrame:
    """The documents with repeats cut out of `text`; `removed` holds (start, end) offsets into the original text."""
    shared_dir(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != removed_as.lower()]
    base = own(docs, *names)
    d, t, doc, thash, marked_as = (fresh(base, x) for x in ("_d", "_t", "_doc", "_thash", "_units"))
    found = marks(docs, segment, line_words).select(F.col("doc_id").alias(doc), F.col("thash").alias(thash), F.col("_units").alias(marked_as))
    keyed = base.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), t: F.xxhash64("text")})
    joined = keyed.join(found, (F.col(d) == F.col(doc)) & (F.col(t) == F.col(thash)), "left").select(*(F.col(f"`{n}`") for n in names), marked_as)
    at_text, at_units = names.index("text"), len(names)
    schema = T.StructType([*base.schema, *T.StructType.fromDDL(f"`{removed_as}` array<struct<start:int,end:int>>")])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in it:
            texts, removed = b.column(at_text).to_pylist(), []
            for i, marked in enumerate(b.column(at_units).to_pylist()):
                gone = spans(texts[i], set(marked), segment, run_words, line_words) if marked else []
                removed.append([{"start": s, "end": e} for s, e in gone])
                if gone:
                    keep, at = [], 0
                    for s, e in gone:
                        keep.append(texts[i][at:s])
                        at = e
                    texts[i] = "".join([*keep, texts[i][at:]])
            cols = [pa.array(texts, pa.string()) if j == at_text else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, kind)], [*names, removed_as])

    return joined.mapInArrow(cut, schema)
