"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's target gives every one of its rows the same expected number of copies c = target / source size. floor(c)
copies are certain; the fraction is rounded by the pivotal method over pairs of rows: probability mass, weighed by size so
that the source's expected words stay exactly the same, moves at random between the two until one of them is 0 or 1. The
other goes on to the next pair. Rows are dealt into blocks of about `block` by a hash; each block folds its pairs and
leaves at most one fractional row, and these residuals are dealt into blocks again: a reduction tree whose levels shrink
by the block size. At its root one row a source stays fractional and is rounded alone; what that leaves off the target is
spread as a small probability over rows of that source far smaller than the gap, which a second tree rounds. A hot source
just has more blocks.

Defined results: a null text has size 0, and rows of size 0 are taken 0 words; a null source is a source, last in order;
repeated rows each count, and those of one doc_id and size may be exchanged; a `key` tells rows apart and is handed through
(without it doc_id is); all randomness is a hash of seed, doc_id and
size, so reruns agree; without any words every target is 0; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import WORD, cut, fresh, own, stored

WEIGHTS = (5, 2, 1)
MOST = 3


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, source, size), and a key if a column for it is named: words per document."""
    words = F.regexp_count("text", F.lit(WORD))
    of = [F.col(f"`{key}`").cast("long").alias("key")] if key else []
    return own(docs, "doc_id", "text", "source", *([key] if key else [])).select(F.col("doc_id").cast("long"), "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"), *of)


def copied(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """The documents, each row as often as the mix takes it; rows without words as often as their source's share rounds to.

    Rows are numbered in a table of their own first, so that repeated ids and repeated rows get their own copies.
    """
    names = docs.columns
    key, of, n, copy = (fresh(docs, x) for x in ("_row", "_of", "_n", "_copy"))
    rows = stored(own(docs, *names).withColumn(key, F.monotonically_increasing_id()), "numbered", "zstd")
    drawn = mix(sized(rows, key), weights, most, seed).where("copies > 0").select(F.col("key").alias(of), F.col("copies").cast("int").alias(n))
    both = rows.join(drawn, F.col(key) == F.col(of))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(F.col(f"`{n}`") for n in names))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) a source: shares by weight, filled up to `most` times the size, the rest reshared.

    Sources fill in the order of cap / weight; below the water level they are full, above it they get level x weight.
    The windows run over one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank, F.lit(len(weights))).cast("int")))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", F.col("source_size") * float(most))
        .withColumn("total", F.sum("source_size").over(every))
        # the level if this source and all after it were not full
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
        .withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    )
    target = F.when(F.col("full") | F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w")))
    return levels.select("source", "source_size", target.alias("target"))


def _uniform(*by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(1 << 52)) / float(1 << 52)


def _fold(rows: Column) -> Column:
    """Pair the rows of a block one after another: the fractional one that is left, and copies of all that are decided."""
    decided = "array<struct<doc_id:bigint,size:bigint,key:bigint,take:int>>"
    none = F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("key"), F.lit(0.0).alias("p"))
    start = F.struct(none.alias("left"), F.array().cast(decided).alias("done"))

    def take(row: Column, one: Column) -> Column:
        return F.struct(row["doc_id"].alias("doc_id"), row["size"].alias("size"), row["key"].alias("key"), F.when(one, 1).otherwise(0).alias("take"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        # the most words that may move to the one held, and to the new one
        up = F.least(a["size"] * (1.0 - a["p"]), x["size"] * x["p"])
        down = F.least(a["size"] * a["p"], x["size"] * (1.0 - x["p"]))
        to_held = x["u"] * (up + down) < down  # by these odds each row's expectation stays
        full_held = to_held & (a["size"] * (1.0 - a["p"]) <= x["size"] * x["p"])
        empty_new = to_held & ~full_held
        empty_held = ~to_held & (a["size"] * a["p"] <= x["size"] * (1.0 - x["p"]))
        held_done = full_held | empty_held
        p_new = F.when(to_held, x["p"] - up / x["size"]).otherwise(x["p"] + down / x["size"])
        p_held = F.when(to_held, a["p"] + up / a["size"]).otherwise(a["p"] - down / a["size"])
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(held_done, p_new).otherwise(p_held)))
        rest = F.struct(*(F.when(held_done, x[c]).otherwise(a[c]).alias(c) for c in ("doc_id", "size", "key")), p.alias("p"))
        out = F.when(held_done, take(a, full_held)).otherwise(take(x, ~empty_new))
        first = F.struct(F.struct(*(x[c].alias(c) for c in ("doc_id", "size", "key", "p"))).alias("left"), acc["done"].alias("done"))
        return F.when(a["size"] == 0, first).otherwise(F.struct(rest.alias("left"), F.concat(acc["done"], F.array(out)).alias("done")))

    return F.aggregate(rows, start, step)


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7, block: int = 48) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, copies, taken) for every row of (doc_id, source, size), with or without a key."""
    sizes = stored(sizes if "key" in sizes.columns else sizes.withColumn("key", F.col("doc_id")), "sizes")
    goal = targets(sizes, weights, most)
    count = sizes.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("rows")).withColumnRenamed("source", "_s")
    plan = cut(goal.join(count, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("s"), "source_size", "target", "rows", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("c")))
    every = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("p", F.col("c") - F.floor("c"))
    # floating point may leave a share of a copy that means none or a whole one
    fraction = (F.col("size") > 0) & (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    whole = every.where(~fraction).select("doc_id", "source", "size", "key", (F.col("p") > 0.5).cast("int").alias("take"))

    levels = _levels(plan, block)
    drawn = cut(whole.withColumn("open", F.lit(False)).unionByName(_tree(every.where(fraction).select("source", "rows", "doc_id", "size", "key", "p"), levels, block, seed).withColumn("open", F.lit(True))))

    # what the last row of each source was rounded by goes to small rows of that source, in a second, finer tree
    off = drawn.join(plan, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg((F.sum((F.floor("c") + F.col("take")) * F.col("size")) - F.first("target")).alias("e"))
    off = cut(off.join(plan.select(F.col("s").alias("_p"), "rows"), F.col("s").eqNullSafe(F.col("_p"))).select("s", "e", "rows"))
    loose = drawn.where("open").join(off, F.col("source").eqNullSafe(F.col("s"))).where((F.col("take") == 1) == (F.col("e") > 0))
    shares = (16, 8, 4, 2, 1)
    mass = loose.groupBy("s").agg(*(F.sum(F.when(F.col("size") * k <= F.abs("e"), F.col("size"))).alias(f"m{k}") for k in shares), F.first("e").alias("_e"))
    enough = [F.when(F.col(f"m{k}") > 1.25 * F.abs("_e"), F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m"))) for k in shares]
    finer = mass.select(F.col("s").alias("f"), F.coalesce(*enough).alias("g")).where("g is not null").select("f", "g.k", "g.m")
    marked = cut(drawn.join(off, F.col("source").eqNullSafe(F.col("s"))).join(finer, F.col("s").eqNullSafe(F.col("f")), "left"))
    again = F.coalesce(F.col("open") & ((F.col("take") == 1) == (F.col("e") > 0)) & (F.col("size") * F.col("k") <= F.abs("e")), F.lit(False))
    p = F.abs("e") / F.col("m")
    second = marked.where(again).select("source", "rows", "doc_id", "size", "key", F.when(F.col("take") == 1, 1 - p).otherwise(p).alias("p"))
    final = marked.where(~again).select("doc_id", "source", "size", "key", "take").unionByName(_tree(second, levels, block, seed + 10))

    copies = (F.floor("c") + F.col("take")).cast("long")
    out = final.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "key", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _tree(now: DataFrame, levels: int, block: int, seed: int) -> DataFrame:
    """(doc_id, source, size, key, take): every row of (source, rows, doc_id, size, key, p) rounded to 0 or 1, level by level."""
    decided = []
    for level in range(levels):
        blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / float(block) ** (level + 1)))
        place = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size")
        row = F.struct(place.alias("h"), "doc_id", "size", "p", _uniform(F.lit(seed + 1), F.lit(level), F.col("doc_id"), F.col("size")).alias("u"), "key")
        folded = now.groupBy("source", "rows", F.pmod(place, blocks).alias("b")).agg(_fold(F.sort_array(F.collect_list(row))).alias("x"))
        folded = cut(folded.select("source", "rows", "x.left", "x.done"))
        decided.append(folded.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.key", "d.take"))
        now = folded.where("left.size > 0").select("source", "rows", "left.doc_id", "left.size", "left.key", "left.p")
    decided.append(now.select("doc_id", "source", "size", "key", (_uniform(F.lit(seed + 2), F.col("doc_id"), F.col("size")) < F.col("p")).cast("int").alias("take")))
    return reduce(DataFrame.unionByName, decided)


def _levels(plan: DataFrame, block: int) -> int:
    """Levels until the largest source fits one block."""
    rows = plan.agg(F.max("rows")).first()[0] or 0
    levels = 1
    while block**levels < rows:
        levels += 1
    return levels if rows else 0
