"""I-Match document fingerprints, in DataFrame operations only.

A lexicon keeps the terms within a band of inverse document frequency, idf_low <= ln(N / df) <= idf_high. At least
N x exp(-idf_high) documents hold each of them, so there are at most exp(idf_high) x the mean number of distinct terms of
a document: a bound that does not grow with the corpus, and the lexicon is broadcast only while it keeps under it.

There are 16 random subsets of the lexicon, the same for all texts. A term's SHA-256 decides on each of them: subset k keeps
a term with chance 2^-SPARSE[k]. Of each subset a text's distinct terms that are in it are sorted and hashed; the fingerprint
is all 16 hashes, with zeros for a subset that holds none of the text's terms. The subsets are sparse, since an edit of
half a text changes most of its terms, and differ in how sparse, so that texts of ten terms and of a thousand have subsets
that hold a few of theirs. The likeness of two fingerprints is the share of agreeing hashes among the subsets that hold
terms of either text. A text without a term in any subset hashes whole, so equal texts have equal fingerprints and
different ones without common terms don't look alike. Only terms that are in a subset move.

Neighbours by doc_id meet in places: ranges of doc_id between measured quantiles, taken level by level, and ranges of a
text hash where one doc_id (or none) has many rows. One shuffle brings a place's texts together, with the first row of the
next place; everything after it, edits, both fingerprints and likeness, stays in that partition.

Terms are the lower-cased runs of signs other than white space. Defined results: a null text counts as empty; an
empty text has the fingerprint of no terms; the edited text of a document takes the first code points of the next one
(descending doc_id, null last, equal ones by a hash of the text; after the last the first); a table of one row edits itself with itself;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import SPACE, cut, own, stored

#: A term is in subset k with chance 2^-SPARSE[k].
SPARSE = (3, 4, 5, 6, 6, 7, 7, 7, 8, 8, 8, 8, 9, 9, 9, 10)
SUBSETS, EMPTY = len(SPARSE), "0" * 8
IDF_LOW, IDF_HIGH = 1.0, 7.0
#: The most rows that are broadcast (about 50 bytes each); a larger lexicon joins by a shuffle.
MOST_BROADCAST = 600_000
#: A place holds texts of about so many bytes, counted by units; ranges are cut LEVELS times into at most WAYS by quantiles, and about MOST_PLACES are made at most.
PLACE_BYTES, UNIT, WAYS, LEVELS, MOST_PLACES = 1 << 18, 2048, 64, 3, 1 << 18


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SPACE)), "")


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> tuple[DataFrame, bool]:
    """(term, head, subsets) of all terms in the band that a subset keeps, and whether it is small enough to broadcast.

    head is 60 bits of MD5, subsets a bit a subset. Counts cover all documents.
    """
    n = docs.count()
    low, high = n * math.exp(-idf_high), n * math.exp(-idf_low)
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    value = lambda text: F.conv(text, 16, 10).cast("long")
    sha = F.sha2(F.col("term").cast("binary"), 256)
    held = [F.when(value(F.substring(sha, 1 + 4 * k, 4)) < 1 << 16 - bits, 1 << k).otherwise(0) for k, bits in enumerate(SPARSE)]
    head = value(F.substring(F.md5(F.col("term").cast("binary")), 1, 15))
    kept = cut(df.where(F.col("df").between(max(low, 2), high)).select("term", head.alias("head"), reduce(Column.bitwiseOR, held).alias("subsets")))
    kept = kept.where("subsets <> 0")  # after the cut, else Spark would hash every occurrence of a term to filter before it counts
    return kept, kept.count() <= MOST_BROADCAST


def subset_hashes(packs: Column, whole: Column) -> Column:
    """Fingerprint of an array of (head, subsets), sorted; `whole` stands in where there is none."""
    def one(k: int) -> Column:
        mine = F.transform(F.filter(packs, lambda p: p["subsets"].bitwiseAND(F.lit(1 << k)) != 0), lambda p: p["head"].cast("string"))
        code = lambda heads: F.when(F.size(heads) == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(heads, ",").cast("binary")), 1, 8))
        return F.get(F.transform(F.array(mine), code), 0)  # bound as an element, so that it is filtered once

    bare = F.substring(F.md5(F.concat(F.lit("="), whole).cast("binary")), 1, 8)
    return F.when(F.size(packs) == 0, F.repeat(bare, F.lit(SUBSETS))).otherwise(F.concat(*(one(k) for k in range(SUBSETS))))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets that agree, of those that hold terms of either text."""
    of = lambda x, k: F.substring(x, 8 * k + 1, 8)
    same = [F.when((of(a, k) == of(b, k)) & (of(a, k) != EMPTY), 1).otherwise(0) for k in range(SUBSETS)]
    either = [F.when((of(a, k) != EMPTY) | (of(b, k) != EMPTY), 1).otherwise(0) for k in range(SUBSETS)]
    return sum(same[1:], same[0]) / F.greatest(sum(either[1:], either[0]), F.lit(1)).cast("double")


def fingerprint(texts: DataFrame, lex: DataFrame, small: bool, keys: tuple[str, ...], *carry: str) -> DataFrame:
    """(*keys, fingerprint, *carry) of (*keys, text, *carry); the keys tell rows apart."""
    found = texts.select(*keys, *carry, F.md5(F.col("text").cast("binary")).alias("whole"), F.posexplode_outer(terms(F.col("text"))).alias("pos", "term"))
    first = F.coalesce("pos", F.lit(0)) == 0  # what is carried rides on a text's first term only
    joined = found.join(F.broadcast(lex) if small else lex, "term", "left").where(F.col("head").isNotNull() | first)
    slim = joined.select(*keys, F.when(F.col("head").isNotNull(), F.struct("head", "subsets")).alias("pack"), *(F.when(first, F.col(c)).alias(c) for c in ("whole", *carry)))
    packs = slim.groupBy(*keys).agg(F.sort_array(F.collect_list("pack")).alias("packs"), *(F.first(c, ignorenulls=True).alias(c) for c in ("whole", *carry)))
    return packs.select(*keys, *carry, subset_hashes(F.col("packs"), F.col("whole")).alias("fingerprint"))


def _places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, thash, place) and (doc_id, thash, place) of every row.

    Quantiles, sums and first rows come from a narrow table of ids, text hashes and units, written once, so that texts are not
    read for them. Ranges are cut LEVELS times whatever the size; only into how many grows with it.
    """
    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("thash", F.xxhash64("text"))
    units = F.floor(F.octet_length("text") / float(UNIT)).cast("int") + 1
    marks = stored(rows.select("doc_id", "thash", units.alias("units")), "imatch-marks")
    total = marks.agg(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("units")))).first()[0] or 0
    size = max(PLACE_BYTES // UNIT, -(-total // MOST_PLACES))
    ways = min(WAYS, max(1, math.ceil((total / size) ** (1 / LEVELS))))
    cuts = F.percentile_approx("doc_id", [i / ways for i in range(1, ways)], 20 * ways) if ways > 1 else F.array().cast("array<bigint>")
    often = F.array_distinct(F.filter("q", lambda x, i: F.get(F.col("q"), i - 1) == x))
    past = F.size(F.filter("tops", lambda e: e <= F.col("doc_id"))) + F.size(F.filter("often", lambda e: e < F.col("doc_id")))
    marks, rows = (x.withColumn("range", F.lit(0).cast("long")) for x in (marks, rows))
    for level in range(LEVELS):  # each range is cut at quantiles of its own rows, and one id that is several of them is a range of its own
        # long texts count for as many rows as they have units
        weighed = marks.where("doc_id is not null").select("range", "doc_id", F.explode(F.sequence(F.lit(1), F.col("units"))))
        if level == 0:  # one range so far
            first = weighed.agg(cuts.alias("q")).select(F.array_distinct("q").alias("tops"), often.alias("often")).first()
            with_tops = lambda x, r=first: x.withColumns({c: F.array(*(F.lit(v) for v in r[c] or [])).cast("array<bigint>") for c in ("tops", "often")})
        else:
            tops = cut(weighed.groupBy("range").agg(cuts.alias("q")).select("range", F.array_distinct("q").alias("tops"), often.alias("often")))
            with_tops = lambda x, tops=tops: x.join(F.broadcast(tops), "range", "left")
        marks, rows = (with_tops(x).withColumn("range", F.col("range") * (2 * WAYS) + F.coalesce(past, F.lit(0))).drop("tops", "often") for x in (marks, rows))
    marks, rows = (x.withColumn("range", F.when(F.col("doc_id").isNotNull(), F.col("range")).otherwise(-1)) for x in (marks, rows))
    # a range of one doc_id is cut by the texts' hashes; places count from the highest range
    stats = marks.groupBy("range").agg(F.sum("units").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one"))
    parts = F.when(F.col("one"), F.ceil(F.col("n") / float(size))).otherwise(1)
    before = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    ranges = cut(stats.select("range", parts.cast("long").alias("parts")).withColumn("base", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("long")))
    part = F.least(F.col("parts") - 1, F.floor((F.col("thash") / float(1 << 64) + 0.5) * F.col("parts")))
    at = lambda x, *names: x.join(F.broadcast(ranges), "range").select(*names, (F.col("base") + part).alias("place"))
    return at(rows, "doc_id", "text", "thash"), at(marks, "doc_id", "thash")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, thash, place): rows of a lower place come first in the order of neighbours.

    The tables that rows are looked up in have at most MOST_PLACES rows for ranges and twice as many for places.
    """
    return _places(docs)[0]


def neighbours(docs: DataFrame) -> DataFrame:
    """(place, rn, guest, doc_id, text, following): each row with the text of the next one, by place and rn.

    The first row of each place also visits the place before it, as a guest after all of its own.
    """
    rows, marks = _places(docs)
    falling = F.bitwise_not("doc_id")
    heads = marks.groupBy("place").agg(F.min(F.struct(falling.alias("k"), "thash")).alias("_h"))
    every = Window.orderBy("place")  # over one row a place
    before = F.coalesce(F.lag("place").over(every), F.max("place").over(Window.partitionBy()))
    first = cut(heads.select(F.col("place").alias("_p"), F.col("_h.k").alias("_k"), F.col("_h.thash").alias("_t"), before.alias("_before")))
    small = first.count() <= MOST_BROADCAST
    guests = rows.join(F.broadcast(first) if small else first, (F.col("place") == F.col("_p")) & falling.eqNullSafe(F.col("_k")) & (F.col("thash") == F.col("_t")))
    guests = guests.groupBy(F.col("_before").alias("place"), "doc_id", "thash").agg(F.min("text").alias("text"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    w = Window.partitionBy("place").orderBy("guest", F.col("doc_id").desc_nulls_last(), "thash", "text")
    return both.select("place", F.row_number().over(w).alias("rn"), "guest", "doc_id", "text", F.lead("text").over(w).alias("following"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document."""
    lex, small = lexicon(docs)
    pairs = neighbours(docs).withColumn("edit", edited(F.col("text"), F.col("following")))
    about = F.struct("guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"))
    none = F.lit(None).cast("struct<guest:boolean,doc_id:bigint,n_chars:bigint,edited_sha256:string>")
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text"), about.alias("about")), F.struct(F.lit(1).alias("version"), F.col("edit").alias("text"), none.alias("about")))
    both = pairs.select("place", "rn", F.explode(F.filter(versions, lambda v: v["text"].isNotNull())).alias("x")).select("place", "rn", "x.*")
    prints = fingerprint(both, lex, small, ("place", "rn", "version"), "about").withColumnRenamed("fingerprint", "fp")
    mine = lambda v: F.max(F.when(F.col("version") == v, F.col("fp")))
    rows = prints.groupBy("place", "rn").agg(mine(0).alias("fingerprint"), mine(1).alias("edited_fingerprint"), F.first("about", ignorenulls=True).alias("about"))
    out = rows.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("place").orderBy("rn"))).where("not about.guest")
    return out.select("about.doc_id", "about.n_chars", "about.edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
