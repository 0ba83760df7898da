"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r have a point between them that is within r/2 of both. So every fingerprint emits all
its variants within half the radius, equal variants meet in a shuffle, and what meets is verified. An odd radius has one
bit left over: the 64 bits are cut into three parts and each variant ignores one of them; of two fingerprints that differ
in r bits some part holds at least one difference, and without it r - 1 remain, an even number to halve. For r = 3 that is
(1 + 43) + (1 + 43) + (1 + 42) = 131 variants of 43, 43 and 42 bits instead of the 2081 of a full ball of radius 2, and the search
stays exact.

Exact copies collapse to one fingerprint before anything is emitted. Fingerprints that meet under one variant are linked
by a spanning forest of their true links, never by all pairs. Components come from alternating large-star and small-star
steps over those edges, each cut by a checkpoint.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other;
repeated rows link to each other; a null doc_id never becomes a component_id unless every row of a component has none;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .util import cut, fresh, join_spread, own, shared_dir, stored, trim

BITS = 64
SEED = 42
#: Bytes of variants that one task sorts at once.
TASK_BYTES = 24 << 20
#: Fingerprints whose variants are made at once.
EMITTED = 8000
#: A meeting of up to so many fingerprints is verified by a matrix of popcounts; a larger one by a local ball search.
SMALL = 512


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint: a bit is 1 if over half the shingles' XXH64 have it; ASCII lower case, repeats count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, thash) per document; fp is the unsigned fingerprint's bits as a signed long, thash tells texts apart."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "thash"])

    shared_dir(docs.sparkSession)
    return own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("thash")).mapInArrow(run, "doc_id long, fp long, thash long")


def _balls(radius: int) -> list[tuple[np.uint64, np.ndarray]]:
    """(bits kept, flips within half the radius) for each part left out."""
    parts = [range(0, BITS)] if radius % 2 == 0 else [range(0, 21), range(21, 42), range(42, BITS)]
    out = []
    for part in parts:
        free = [i for i in range(BITS) if radius % 2 == 0 or i not in part]
        flips = [0]
        reach = {0}
        for _ in range(radius // 2):
            reach = {f ^ (1 << i) for f in reach for i in free}
            flips = sorted(set(flips) | reach)
        out.append((np.uint64(sum(1 << i for i in free)), np.array(flips, np.uint64)))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, to deal variants out evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def forest(fps: np.ndarray, radius: int, keep: np.uint64, variant: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member of its component) over the links of one meeting's distinct fingerprints."""
    n = len(fps)
    if radius % 2 == 0:  # any two that meet are within the radius
        return fps[1:], np.repeat(fps[:1], n - 1)
    if n <= SMALL or radius != 3:
        a, b = _links(fps, np.arange(n), radius)
    else:
        # Three differences fall on the parts as 1+1+1, 2+1+0 or 3+0+0, two as 1+1+0 or 2+0+0. In all but 3+0+0 some part
        # holds one or none and the other two hold two at most, so such links show by the ignored part alone.
        rest, inverse = np.unique(fps & ~keep, return_inverse=True)
        first = np.full(len(rest), n)
        np.minimum.at(first, inverse, np.arange(n))
        a, b = [np.arange(n)], [first[inverse]]
        for bit in range(BITS):
            if (~keep >> np.uint64(bit)) & np.uint64(1):
                at = np.searchsorted(rest, rest ^ np.uint64(1 << bit)).clip(0, len(rest) - 1)
                hit = np.nonzero(rest[at] == rest ^ np.uint64(1 << bit))[0]
                a.append(first[hit])
                b.append(first[at[hit]])
        x, y = _links(fps, np.nonzero(fps & keep == variant)[0], radius)
        a, b = np.concatenate([*a, x]), np.concatenate([*b, y])
    root = _roots(n, a, b)
    at = np.nonzero(root != np.arange(n))[0]
    return fps[at], fps[root[at]]


def _links(fps: np.ndarray, of: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among `of`, by blocks; a block's pairs shrink to a forest before the next."""
    a = b = np.zeros(0, np.int64)
    for i in range(0, len(of), SMALL):
        x, y = np.nonzero(np.bitwise_count(fps[of[i : i + SMALL], None] ^ fps[of[i:]][None, :]) <= radius)
        x, y = of[i + x], of[i + y]
        go = x < y
        a, b = np.concatenate([a, x[go]]), np.concatenate([b, y[go]])
        if len(a) > 8 * len(of):
            root = _roots(len(fps), a, b)
            a = np.nonzero(root != np.arange(len(fps)))[0]
            b = root[a]
    return a, b


def edges(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a spanning forest, for every meeting, of the links between different fingerprints; fp must be distinct."""
    spark = distinct.sparkSession
    balls = _balls(radius)
    codes = sum(len(f) for _, f in balls)
    codes_at = np.cumsum([0, *(len(f) for _, f in balls)])
    n = max(1, -(-distinct.count() * codes * 10 // TASK_BYTES))
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = 4 * n  # lane numbers are dealt by their hash, so several lanes to a task even it out

    def variants(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for part, (keep, flips) in enumerate(balls):
            for j, f in enumerate(flips):
                yield codes_at[part] + j, (fps & keep) ^ f

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(every), EMITTED):
                fps = every[s : s + EMITTED]
                lane, fp, code = [], [], []
                for c, v in variants(fps):
                    lane.append((_mix(v ^ np.uint64(_part(c) + 1)) % np.uint64(lanes)).astype(np.int32))
                    fp.append(fps)
                    code.append(np.full(len(fps), c, np.uint16))
                lane, fp, code = map(np.concatenate, (lane, fp, code))
                order = np.argsort(lane, kind="stable")
                lane, fp, code = lane[order], fp[order], code[order]
                cuts = np.nonzero(np.r_[True, lane[1:] != lane[:-1]])[0]
                ends = np.r_[cuts[1:], len(lane)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lane[cuts]), pa.array([fp[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()), pa.array([code[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary())], ["lane", "fps", "codes"]
                )

    def _part(code: int) -> int:
        return int(np.searchsorted(codes_at, code, "right")) - 1

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_code = [], []
        for b in it:
            held_fp += [np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)]
            held_code += [np.frombuffer(x.as_py(), np.uint16) for x in b.column(2)]
        if not held_fp:
            return
        fp, code = np.concatenate(held_fp), np.concatenate(held_code)
        flips = np.concatenate([f for _, f in balls])
        part_of = np.searchsorted(codes_at, np.arange(codes), "right") - 1
        for part, (keep, _) in enumerate(balls):
            mine = part_of[code] == part
            f, v = fp[mine], (fp[mine] & keep) ^ flips[code[mine]]
            order = np.lexsort((f, v))
            f, v = f[order], v[order]
            edge = np.nonzero(np.r_[True, v[1:] != v[:-1], True])[0] if len(v) else np.zeros(1, np.int64)
            sizes = np.diff(edge)
            pairs = edge[:-1][sizes == 2]
            ok = np.bitwise_count(f[pairs] ^ f[pairs + 1]) <= radius
            out = [(f[pairs + 1][ok], f[pairs][ok])]
            for s, e in zip(edge[:-1][sizes > 2], edge[1:][sizes > 2], strict=True):
                out.append(forest(f[s:e], radius, keep, v[s]))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(a):
                pair = np.unique(np.stack([a, b], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["a", "b"])
        held_fp, held_code, fp, code, f, v, order = [], [], None, None, None, None, None
        trim()

    shared_dir(spark)
    dealt = distinct.select("fp").mapInArrow(emit, "lane int, fps binary, codes binary").repartition(n, "lane")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of (a, b); alternating large-star and small-star steps."""
    e = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(e)
    while True:
        # large star: every neighbour above the centre is linked to the least of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the centre and its neighbours below are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
        e = cut(small)
        if (now := mark(e)) == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, thash: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; component_id is the least doc_id reachable over the links.

    With `thash` also a hash that tells texts apart, and the component's root fingerprint.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = components(edges(distinct.select("fp"), radius))
    rooted = cut(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    of = cut(join_spread(rooted.withColumnRenamed("n", "rows"), least.withColumnRenamed("fps", "n"), "root", rooted.count()).select("fp", "root", "component_id", F.col("rows").alias("n")))
    joined = join_spread(prints, of, "fp", prints.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["thash", "root"] if thash else []))


def firsts(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(_doc, _thash) of one document of each near-duplicate group, that of least doc_id (then of least text hash)."""
    found = near_duplicates(docs, shingle, radius, thash=True)
    return found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("doc_id").alias("_doc"), F.min("thash").alias("_thash")).drop("root")


def only(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents that `first` names, each once."""
    names = docs.columns
    t, doc, thash = (fresh(docs, x) for x in ("_t", "_doc", "_thash"))
    keyed, first = own(docs, *names).withColumn(t, F.xxhash64("text")), first.select(F.col("_doc").alias(doc), F.col("_thash").alias(thash))
    kept = keyed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col(t).eqNullSafe(F.col(thash)))
    return kept.dropDuplicates([doc, t]).select(*(F.col(f"`{n}`") for n in names))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents, of each near-duplicate group only the one of least doc_id (then of least text hash)."""
    return only(docs, firsts(docs, shingle, radius))
