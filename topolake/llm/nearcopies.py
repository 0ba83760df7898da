"""Near copies by the Jaccard similarity of their word shingles, after SimHash has taken out the nearest ones.

Documents whose SimHash fingerprints chain at `radius` bits go first, as in `simhash`. Of what stays, texts of similarity s
share one of BANDS bands of ROWS minimum hashes with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8. Documents are taken
in order of doc_id, and one goes if its exact similarity to one that stays is `similarity` or more and they share a band, so
no group drifts from what stands for it and no two that stay are found alike.

That order is kept without gathering large groups. A document that comes first in all of its bands stays whatever else
does; a first pass compares all that share a band with such a one to it, a pair a row, wherever the rows are. What is left
undecided, and shares bands only among itself, is linked by stars, and a component of those links comes to one task in order,
where only the shingles of what stays are held.

Defined results: as for `simhash.keep_one`, but that texts of one doc_id follow by a hash of both; shingles are distinct, ASCII lower case; a text of fewer words than a shingle
is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .util import cut, join_spread, own, shared_dir, slices, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Shingles of a text that more than one pair in HOT is compared with are broadcast; there are at most HOT such texts.
HOT = 200
_ODD = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = (1 << 63) - 1


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(simhash.SEED)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of minimum hashes; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[at : at + 2048, None] * _ODD).min(axis=0))
        out = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            out = simhash._mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _copies(docs: DataFrame, first: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, thash) of those among `first` (_doc, _thash) that are near copies of others that stay."""
    shared_dir(docs.sparkSession)
    keyed = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("thash"))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [bands(shingles(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "thash", "bands"])

    same = lambda a, b: a["doc_id"].eqNullSafe(b["_doc"]) & (a["thash"] == b["_thash"])
    printed = keyed.mapInArrow(emit, "doc_id long, thash long, bands array<long>")
    rows = stored(printed.join(first, same(printed, first), "left_semi").dropDuplicates(["doc_id", "thash"]).withColumn("node", F.xxhash64("doc_id", "thash")), "bands")

    # the first of each band; one that is first in all of its bands stays
    one = rows.select("node", F.explode("bands").alias("band"), F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "node").alias("at"))
    heads = cut(one.groupBy("band").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.col("head.node").alias("head"), "n"))
    met = stored(join_spread(one.select("node", "band"), heads, "band", rows.count() * BANDS), "met")
    stays = cut(met.groupBy("node").agg(F.max((F.col("node") != F.col("head")).cast("int")).alias("later")).where("later = 0").select(F.col("node").alias("head")))
    pairs = cut(met.where("node <> head").select("node", "head").distinct().join(stays, "head", "left_semi"))
    # texts move once, and only of those that share a band
    some = cut(rows.select("node", F.col("doc_id").alias("_doc"), F.col("thash").alias("_thash")).join(met.select("node").distinct(), "node"))
    shared = stored(keyed.join(some, same(keyed, some)).dropDuplicates(["node"]).select("node", "doc_id", "thash", "text"), "shared")
    texts = lambda nodes, name: shared.join(nodes.select(F.col(name).alias("node")).distinct(), "node").select("node", "text")

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["head", "held"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node) of rows (node, text, held) whose text is near what is held."""
        for b in slices(it):
            near = []
            for node, text, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if alike(shingles(text.as_py(), shingle), np.frombuffer(held.as_buffer(), np.uint64)) >= similarity:
                    near.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], ["node"])

    kept = stored(texts(pairs, "head").mapInArrow(hashed, "head long, held binary"), "heads")
    counted = kept.join(pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "head")
    both = texts(pairs, "node").join(join_spread(pairs, counted, "head", pairs.count(), HOT), "node").select("node", "text", "held")
    gone = cut(both.mapInArrow(verify, "node long").distinct())

    # what is undecided, among itself
    left = met.select("node", "band").join(gone, "node", "left_anti").join(stays.select(F.col("head").alias("node")), "node", "left_anti")
    again = cut(left.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    linked = simhash.components(join_spread(left, again, "band", rows.count() * BANDS).select(F.col("node").alias("a"), F.col("least").alias("b")))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())  # a root is no node of its own
    dealt = shared.join(linked, "node").select("doc_id", "thash", "text", "root", F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "node").repartition("root").sortWithinPartitions("root", "rank", "node")

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by component and rank; only the shingles of what stays of one component are held."""
        root = last = None
        kept: list[np.ndarray] = []
        at: dict[int, list[int]] = {}
        for b in it:
            gone = []
            for i, (doc, thash, r) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if r != root:
                    root, last, kept, at = r, None, [], {}
                if (doc, thash) == last:  # a repeated row
                    continue
                last = (doc, thash)
                h = shingles(b.column(2)[i].as_py(), shingle)
                mine = bands(h).tolist()
                met = {k for x in mine for k in at.get(x, ())}
                if any(min(len(h), len(kept[k])) >= similarity * max(len(h), len(kept[k])) and alike(h, kept[k]) >= similarity for k in sorted(met)):
                    gone.append((doc, thash))
                    continue
                for x in mine:
                    at.setdefault(x, []).append(len(kept))
                kept.append(h)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in gone], pa.int64()), pa.array([t for _, t in gone], pa.int64())], ["doc_id", "thash"])

    return dealt.mapInArrow(judge, "doc_id long, thash long").unionByName(rows.join(gone, "node", "left_semi").select("doc_id", "thash"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = 3) -> DataFrame:
    """The documents without near copies of others that stay; the one of least doc_id (then of least text hash) stays."""
    first = cut(simhash.firsts(docs, shingle, radius))
    gone = _copies(docs, first, shingle, similarity)
    return simhash.only(docs, first.join(gone, first["_doc"].eqNullSafe(gone["doc_id"]) & (first["_thash"] == gone["thash"]), "left_anti"))
