"""Exact top-k search: BM25 over an inverted index with block-max WAND, a shard at a time.

Documents are indexed in shards of `SHARD` documents: sorted term hashes, postings (document, frequency), lengths. Within a
shard documents stand in order of likeness (the signs of the leading directions of its common terms, then length), so that a
block of `BLOCK` neighbours has small maxima for the terms of others. Global statistics (documents, mean length, document
frequencies) are counted over all shards and the same for every shard, so a shard's scores are final and shards merge exactly.

All lists of a shard share the blocks' borders, so WAND's pivot, the first document that the maxima of the lists before it
let reach the k-th score, is looked for by block: a query's bound in a block is the sum of its terms' maxima there. Each
query goes to the block of its greatest bound first, which raises its k-th score, and then on from pivot block to pivot block,
those whose bound reaches its own k-th score; all its cursors skip what lies between. Rare terms' postings are summed
beforehand, so their part of the bound is exact; common terms' impacts stand by block, and the queries that stop at a block
are scored there together. The k-th score carries over from shard to shard within a task. Nothing that could enter the
top k is skipped, so results are those of scoring everything.

score = sum over distinct query terms of ln(1 + (N - df + 0.5) / (df + 0.5)) x tf (k1 + 1) / (tf + k1 (1 - b + b dl / mean dl)),
rounded to 6 decimals; ties go to the smaller doc_id. Terms are lower-cased (A-Z) words between white space.

Defined results: a null or empty text is indexed with length 0 and never found; a query without terms finds nothing; a
query finds itself if it is in the index; repeated rows are found each, those of one doc_id in any order; a null doc_id
sorts last; an empty index finds nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .util import own, shared_dir, stored

K1, B = 1.2, 0.75
SHARD, BLOCK = 4096, 64
#: Scores (queries x documents) that a shard works on at once.
TABLE = 1 << 19
#: Common terms and their leading directions by which a shard's documents are ordered.
AXES, DIRECTIONS = 128, 4
#: The most terms of a shard that are also kept by block, and of what share of its documents (1 in FRACTION) they are.
COMMON, FRACTION = 512, 16
#: Bytes of text after which a shard is closed even with fewer documents.
SHARD_BYTES = 16 << 20
#: Terms (12 bytes each) and queries of a block of queries that is sent to the executors at once.
BLOCK_TERMS, BLOCK_QUERIES = 1_500_000, 50_000
_LAST = (1 << 63) - 1


def counted(text: str | None, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct term hashes, frequencies); cache maps words to hashes and is emptied when it grows."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(cache) > 100_000:
        cache.clear()
    got = list(map(cache.get, words))
    if None in got:
        for i, h in enumerate(got):
            if h is None:
                w = words[i]
                got[i] = cache[w] = xxhash.xxh3_64_intdigest(w) >> 1
    h, n = np.unique(np.array(got, np.int64), return_counts=True)
    return h, n.astype(np.int32)


def likeness_order(start: np.ndarray, size: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An order of a shard's documents in which like ones are neighbours; postings are of term i from start[i], size[i] of them."""
    top = np.argsort(-size, kind="stable")[:AXES]
    x = np.zeros((len(lengths), len(top)))
    for j, t in enumerate(top):
        x[doc[start[t] : start[t] + size[t]], j] = 1
    x /= np.sqrt(x.sum(axis=1, keepdims=True) + 1e-9)
    x -= x.mean(axis=0)
    lead = np.linalg.eigh(x.T @ x)[1][:, -DIRECTIONS:] if len(top) else np.zeros((0, 1))
    return np.lexsort((lengths, (x @ lead > 0) @ (1 << np.arange(lead.shape[1]))))


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard: ids, lengths, terms, offsets and postings (documents, frequencies), packed."""
    shared_dir(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, freqs, size, cache = [], [], [], 0, {}

        def flush() -> pa.RecordBatch:
            n = np.array([len(t) for t in terms])
            lengths = np.array([f.sum() for f in freqs], np.int32)
            h, f = np.concatenate(terms), np.concatenate(freqs)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), n)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            start = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, np.int64)
            place = likeness_order(start, np.diff(np.r_[start, len(h)]), doc, lengths)
            rank = np.empty(len(place), np.uint16)
            rank[place] = np.arange(len(place))
            packed = [np.array([_LAST if i is None else i for i in ids], np.int64)[place], lengths[place], h[start], np.r_[start, len(h)].astype(np.int32), rank[doc], f[order]]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed] + [pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], ["ids", "lengths", "terms", "offsets", "docs", "freqs", "n", "total"])

        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                h, n = counted(text, cache)
                ids.append(i)
                terms.append(h)
                freqs.append(n)
                size += len(text or "")
                if len(ids) >= SHARD or size >= SHARD_BYTES:
                    yield flush()
                    ids, terms, freqs, size = [], [], [], 0
        if ids:
            yield flush()

    ddl = "ids binary, lengths binary, terms binary, offsets binary, docs binary, freqs binary, n long, total long"
    return stored(own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl), "index")


class _Shard:
    """A shard's postings as impacts under the global statistics, by the terms of a block of queries."""

    def __init__(self, row: dict, vocabulary: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        lengths = np.frombuffer(row["lengths"], np.int32)
        terms, offsets = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["offsets"], np.int32)
        self.doc, freq = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["freqs"], np.int32)
        at = np.searchsorted(terms, vocabulary).clip(0, max(0, len(terms) - 1))
        here = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.start, self.end = (np.where(here, x[at], 0) if len(terms) else np.zeros(len(vocabulary), np.int32) for x in (offsets[:-1], offsets[1:]))
        norm = K1 * (1 - B + B * lengths / mean)
        impact = freq * (K1 + 1) / (freq + norm[self.doc])
        # what each posting adds to a score, and the most common terms also by document, with the greatest of each block
        df = self.end - self.start
        of = np.zeros(len(terms))
        of[at[here]] = idf[here]
        self.adds = impact * np.repeat(of, np.diff(offsets))
        top = np.argsort(-df, kind="stable")[:COMMON]
        top = np.sort(top[df[top] > n // FRACTION])
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[top] = np.arange(len(top))
        blocks = -(-n // BLOCK)
        dense = np.zeros((len(top), blocks * BLOCK))
        for r, t in enumerate(top):
            dense[r, self.doc[self.start[t] : self.end[t]]] = self.adds[self.start[t] : self.end[t]]
        dense = dense.reshape(len(top), blocks, BLOCK)
        self.most = dense.max(axis=2)
        self.dense = np.ascontiguousarray(dense.transpose(1, 0, 2))
        #: Blocks that queries stopped at, and all that there were.
        self.visited, self.passed = 0, 0

    def search(self, q: np.ndarray, terms: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Bring the k best of (scores, ids), a row a query, up to date; (q, term) pairs are the queries' terms."""
        n, blocks, (count, k) = len(self.ids), self.most.shape[1], scores.shape
        row, size = self.row[terms], self.end[terms] - self.start[terms]
        rare = (row < 0) & (size > 0)
        # rare terms: all their postings at once
        some = size[rare]
        at = np.repeat(self.start[terms[rare]] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum()) if some.size else np.zeros(0, np.int64)
        wide = blocks * BLOCK
        part = np.bincount(np.repeat(q[rare] * wide, some) + self.doc[at], self.adds[at], count * wide).astype(float, copy=False).reshape(count, blocks, BLOCK)
        weight = np.zeros((count, len(self.most)))
        weight[q[row >= 0], row[row >= 0]] = 1
        bound = part.max(axis=2) + weight @ self.most
        # scores are compared rounded, and rounding moves both the carried k-th score and those met here
        least = scores[:, -1] - 1e-5
        hits: list[tuple[np.ndarray, ...]] = []

        def stop(go: np.ndarray) -> None:
            """Score the queries of each block's column in their blocks; go holds a row a block."""
            for b in np.nonzero(go.any(axis=1))[0]:
                who = np.nonzero(go[b])[0]
                self.visited += len(who)
                got = part[who, b] + weight[who] @ self.dense[b]
                x, d = np.nonzero((got >= least[who, None]) & (got > 0))
                hits.append((who[x], got[x, d], b * BLOCK + d))

        best = bound.argmax(axis=1)
        ahead = (np.arange(blocks)[:, None] == best) & ((bound.max(axis=1) >= least) & (bound.max(axis=1) > 0))
        stop(ahead)
        if hits:  # the k-th score that a query's first block shows
            who, got = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
            order = np.lexsort((-got, who))
            first = np.searchsorted(who[order], np.arange(count))
            kth = first + k - 1
            enough = kth < np.searchsorted(who[order], np.arange(count), "right")
            least[enough] = np.maximum(least[enough], got[order[kth[enough]]] - 1e-5)
        stop((bound.T >= least) & (bound.T > 0) & ~ahead)
        self.passed += count * blocks
        if not hits:
            return
        who, got, d = (np.concatenate([h[i] for h in hits]) for i in range(3))
        near = got >= least[who]
        who, value, doc = who[near], np.round(got[near], 6), self.ids[d[near]]
        every_q, every_s, every_d = np.r_[np.repeat(np.arange(count), k), who], np.r_[scores.ravel(), value], np.r_[ids.ravel(), doc]
        order = np.lexsort((every_d, -every_s, every_q))
        start = np.searchsorted(every_q[order], np.arange(count))
        best = order[(start[:, None] + np.arange(k)).ravel()]
        scores[:], ids[:] = every_s[best].reshape(count, k), every_d[best].reshape(count, k)


def _queries(rows: DataFrame) -> DataFrame:
    """(query_id, terms, size) of (query_id, text): packed sorted hashes of distinct terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in it:
            got = [counted(t.as_py(), cache)[0] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in got], pa.binary()), pa.array([len(g) for g in got], pa.int64())], ["query_id", "terms", "size"])

    return stored(rows.mapInArrow(run, "query_id long, terms binary, size long").where("size > 0"), "queries")


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best of the index for every (query_id, text)."""
    spark = index.sparkSession
    sc = spark.sparkContext
    whole = index.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, mean = whole["n"] or 0, max((whole["total"] or 0) / max(whole["n"] or 0, 1), 1e-9)
    asked = _queries(own(queries, "query_id", "text"))
    total = asked.agg(F.sum("size").alias("terms"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-(total["terms"] or 0) // BLOCK_TERMS), -(-total["n"] // BLOCK_QUERIES))
    out = []
    for block in range(blocks):
        # a block of queries is bounded by BLOCK_TERMS and BLOCK_QUERIES; blocks follow one another, each over all shards
        rows = asked.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(blocks)) == block).orderBy("query_id", "terms").collect()
        if not rows:
            continue
        vocabulary, flat = np.unique(np.concatenate([np.frombuffer(r["terms"], np.int64) for r in rows]), return_inverse=True)
        ends = np.cumsum([r["size"] for r in rows])
        shared = sc.broadcast(vocabulary)

        def count(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v = shared.value
            df = np.zeros(len(v), np.int64)
            for b in it:
                for terms, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t, size = np.frombuffer(terms, np.int64), np.diff(np.frombuffer(offsets, np.int32))
                    at = np.searchsorted(v, t).clip(0, len(v) - 1)
                    hit = v[at] == t
                    df[at[hit]] += size[hit]
            at = np.nonzero(df)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

        df = np.zeros(len(vocabulary))
        got = index.select("terms", "offsets").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[got["term"].to_numpy()] = got["df"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        asks = sc.broadcast((np.array([_LAST if r["query_id"] is None else r["query_id"] for r in rows], np.int64), flat.astype(np.int32), ends, idf))

        def find(it: Iterator[pa.RecordBatch], shared=shared, asks=asks) -> Iterator[pa.RecordBatch]:
            ids, flat, ends, idf = asks.value
            scores, found = np.zeros((len(ids), k)), np.full((len(ids), k), _LAST)
            starts = np.r_[0, ends[:-1]]
            for b in it:
                for row in b.to_pylist():
                    shard = _Shard(row, shared.value, idf, mean)
                    step = max(1, TABLE // max(1, len(shard.ids)))
                    for a in range(0, len(ids), step):
                        z = min(a + step, len(ids))
                        terms = flat[starts[a] : ends[z - 1]]
                        q = np.repeat(np.arange(z - a), ends[a:z] - starts[a:z])
                        shard.search(q, terms, scores[a:z], found[a:z])
            full = (scores > 0).sum(axis=1)
            keep = np.nonzero(full)[0]
            flat_at = np.concatenate([np.arange(n) + i * k for i, n in zip(keep, full[keep], strict=True)]) if len(keep) else np.zeros(0, np.int64)
            packed = pa.StructArray.from_arrays([pa.array(-scores.ravel()[flat_at]), pa.array(found.ravel()[flat_at])], ["neg", "doc_id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(keep.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full[keep])].astype(np.int32)), packed)], ["query_id", "q", "best"])

        # a task gives one row a query, its k best; they merge by query
        best = index.drop("n", "total").mapInArrow(find, "query_id long, q int, best array<struct<neg:double,doc_id:bigint>>")
        merged = best.groupBy("q").agg(F.first("query_id").alias("query_id"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        top = merged.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", F.col("b.doc_id").alias("doc_id"), (F.col("pos") + 1).alias("rank"), (-F.col("b.neg")).alias("score"))
        out.append(stored(top.select(*(F.when(F.col(c) != _LAST, F.col(c)).alias(c) for c in ("query_id", "doc_id")), "rank", "score"), "found"))
    if not out:
        return spark.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    return reduce(DataFrame.unionByName, out)
