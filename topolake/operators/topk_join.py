"""The best partners of each row by a sum of shared features, without meeting all rows that share a common one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import many, small, top_by, written as cut

#: The signs between the features of a set; no feature holds it.
_SEP = "\x1f"
#: All pairs are made of a feature that so many rows of one side have.
FEW = 4
#: A set of features that so many kinds of rows have is not grown: all of them are compared.
LISTED = 256


def feature_lists(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, row, rest) of each side: a row's features that both sides have, the rarest on the right first.

    left, right: (id, row, feature, kind, weight); row tells rows of one id apart.
    """
    often = right.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(many(left.select("feature").distinct()), "feature")
    sides = [df.distinct().join(many(often), "feature").groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("n", "feature", "kind", "weight"))).alias("rest")) for df in (left, right)]
    return sides[0], sides[1]


def _grown(df: DataFrame, most: int) -> DataFrame:
    """Each set with one more of its row's later features, of another kind than it has; of kind 0 it may have `most`."""
    made = ("rest", "key", "score", "many", "kinds")
    own = [c for c in df.columns if c not in made]
    every = df.select(*own, *made[1:], F.col("rest").alias("_rest"), F.posexplode("rest").alias("_at", "_x"))
    kind = F.col("_x.kind")
    fits = F.when(kind == 0, F.col("many") < most).otherwise(F.call_function("shiftright", F.col("kinds"), kind).bitwiseAND(F.lit(1)) == 0)
    return every.where(fits).select(
        *own, F.concat("key", F.lit(_SEP), "_x.feature").alias("key"), (F.col("score") + F.col("_x.weight")).alias("score"),
        (F.col("many") + (kind == 0).cast("int")).alias("many"), F.when(kind == 0, F.col("kinds")).otherwise(F.col("kinds").bitwiseOR(F.call_function("shiftleft", F.lit(1), kind))).alias("kinds"),
        F.slice("_rest", F.col("_at") + 2, F.greatest(F.size("_rest") - F.col("_at") - 1, F.lit(0))).alias("rest"),
    )


def _hope(most: int) -> Column:
    """The most that a set can come to with what its row has left; a kind that it has brings no more."""
    of = lambda kind: F.aggregate(F.filter("rest", lambda x: x["kind"] == kind), F.lit(0), lambda far, x: F.greatest(far, x["weight"]))
    new = lambda kind: F.when(F.call_function("shiftright", F.col("kinds"), F.lit(kind)).bitwiseAND(F.lit(1)) == 0, of(kind)).otherwise(0)
    return F.col("score") + F.least(F.size(F.filter("rest", lambda x: x["kind"] == 0)), most - F.col("many")) * of(0) + reduce(Column.__add__, (new(k) for k in range(1, 5)))


#: A feature's number and kind are the lower bits of its code and its weight the higher ones.
_WEIGHT = 53


def _scored(pairs: DataFrame, base: int, most: int) -> DataFrame:
    """Pairs with what the features that both have come to: of kind 0 the `most` weightiest, of each other kind one."""
    shared = lambda kind: F.array_intersect(f"l_have.k{kind}", f"r_have.k{kind}")
    weight = lambda code: F.coalesce(F.shiftright(code, _WEIGHT), F.lit(0))
    own = [c for c in pairs.columns if c not in ("l_have", "r_have")]
    met = pairs.select(*own, F.sort_array(shared(0), asc=False).alias("_0"), *(F.array_max(shared(k)).alias(f"_{k}") for k in range(1, 5)))
    return met.select(*own, (reduce(Column.__add__, [weight(F.get("_0", F.lit(i))) for i in range(most)] + [weight(F.col(f"_{k}")) for k in range(1, 5)]) + base).cast("int").alias("score"))


def best_pairs(left: DataFrame, right: DataFrame, k: int, least: int, base: int, most: int) -> DataFrame:
    """(left_id, right_id): among them each left id's k best partners of `least` or more, ties to the smaller right id.

    left, right: (id, row, feature, kind, weight), a feature once a row. A pair's score is base and the weights of the features
    that its rows share, of kind 0 those of the `most` weightiest and of each other kind (1 to 4) that of one.

    A feature that FEW rows of one side or fewer have gives all its pairs, which are FEW times its rows at most. Any other
    partner is as good as the rest of the features say, so rows that agree in those are of one kind, and kinds of the left
    look for partners among kinds of the right: a kind is known by its k smallest ids.
    """
    sizes = [df.groupBy("feature", *own).agg(F.count(F.lit(1)).alias(n)) for df, n, own in ((left, "nl", ("kind", "weight")), (right, "nr", ()))]
    wide = cut(sizes[0].join(many(sizes[1]), "feature").where(F.least("nl", "nr") > FEW).select("feature", "kind", "weight", (F.col("weight").cast("long") * (1 << _WEIGHT) + F.monotonically_increasing_id() * 8 + F.col("kind")).alias("code")))
    known = small(wide.select("feature", "code"))
    rare = [df.join(known.select("feature"), "feature", "left_anti").select("id", "feature") for df in (left, right)]
    pairs = rare[0].withColumnRenamed("id", "left_id").join(many(rare[1].withColumnRenamed("id", "right_id")), "feature").select("left_id", "right_id")
    # a row's other features as codes; rows of equal ones are alike
    rows = [df.select("id", "row", "feature").join(known, "feature").groupBy("id", "row").agg(F.sort_array(F.collect_set("code")).alias("have")).select("id", F.xxhash64("have").alias("like"), "have").transform(cut) for df in (left, right)]
    best = _best_likes(rows[0], rows[1], k, least, base, most).groupBy("like").agg(F.collect_list("right_id").alias("ids"))  # k at most
    alike = rows[0].select(F.col("id").alias("left_id"), "like").join(many(best), "like").select("left_id", F.explode("ids").alias("right_id"))
    return cut(pairs).unionByName(alike).repartition("right_id").distinct()


def _best_likes(left: DataFrame, right: DataFrame, k: int, least: int, base: int, most: int) -> DataFrame:
    """(like, right_id, score): the k best partners of each kind of left rows. left, right: (id, like, have).

    Kinds meet by sets of features, grown from the rarest. A set that LISTED kinds or fewer have gives them all. Of a common
    one the kinds of the k smallest ids are enough, if the set alone makes `least`: any other partner that shares just this set
    comes after them. It is then grown by each later feature, so a partner that shares more is found under the larger set. A
    set that can't come to a kind's k-th score so far is left; the sets with most to hope for are taken first.
    """
    ids = top_by(right.select("like", "id").distinct(), ["like"], k, F.col("id")).groupBy("like").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")).transform(cut)
    haves = [df.groupBy("like").agg(F.first("have").alias("have")).transform(cut) for df in (left, right)]
    told = lambda df: df.select(F.col("like").alias("id"), F.lit(0).alias("row"), F.explode("have").alias("x")).select("id", "row", F.col("x").cast("string").alias("feature"), (F.col("x") % 8).cast("int").alias("kind"), F.shiftright("x", _WEIGHT).cast("int").alias("weight"))
    of_kind = lambda n: F.filter("have", lambda x: x % 8 == n).alias(f"k{n}")
    parted = lambda df, name: cut(df.select("like", F.struct(*map(of_kind, range(5))).alias(name)))
    start = (F.lit("").alias("key"), F.lit(base).alias("score"), F.lit(0).alias("many"), F.lit(0).alias("kinds"))
    l, r = (df.select(F.col("id").alias("like"), *start, "rest") for df in feature_lists(told(haves[0]), told(haves[1])))
    l, r = cut(_grown(l, most).withColumn("hope", _hope(most)).where(F.col("hope") >= least)), _grown(r.join(many(ids.select("like", "first")), "like"), most)
    mine, facts = parted(haves[0], "l_have"), small(parted(haves[1], "r_have").join(many(ids.select("like", "first")), "like").withColumnRenamed("like", "right"))
    # the sets with most to hope for, then what of the others may still be among the k best
    first = F.col("hope") == F.max("hope").over(Window.partitionBy("like"))
    waiting, l = (l.withColumn("_first", first).where(x).drop("_first") for x in (~F.col("_first"), F.col("_first")))
    best, opened = None, None
    while True:
        r = cut(r)
        asked = l if waiting is None else l.unionByName(waiting)
        near = F.dense_rank().over(Window.partitionBy("key").orderBy("first"))
        listed = r.select("key", "first", F.col("like").alias("right")).join(many(asked.select("key").distinct()), "key", "left_semi").withColumn("near", near).where(F.col("near") <= LISTED + 1)
        lists = cut(listed.groupBy("key").agg(F.max("near").alias("n"), F.collect_list(F.struct("near", "right")).alias("rights")))
        for sets in (l, waiting):
            if sets is None:
                continue
            sets = sets if best is None else _hopeful(sets, best, k)
            met = sets.join(many(lists), "key")
            common = F.col("n") > LISTED
            pairs = met.where(~common | (F.col("score") >= least)).select("like", F.explode(F.filter("rights", lambda x: ~common | (x["near"] <= k))["right"]).alias("right")).distinct()
            found = _scored(pairs.join(many(mine), "like").join(facts, "right"), base, most)
            # the k best ids are in the kinds up to the k-th of their first ids
            by = Window.partitionBy("like").orderBy(F.desc("score"), "first")
            once = F.row_number().over(Window.partitionBy("like", "first").orderBy(F.desc("score")))
            kept = found.withColumn("_once", (once == 1).cast("int")).withColumn("_at", F.sum("_once").over(by)).where((F.col("_at") <= k) & (F.col("score") >= least))
            new = kept.join(many(ids.select(F.col("like").alias("right"), "ids")), "right").select("like", F.explode("ids").alias("right_id"), "score")
            new = (new if best is None else new.unionByName(best)).groupBy("like", "right_id").agg(F.max("score").alias("score"))
            best = cut(top_by(new, ["like"], k, F.desc("score"), F.col("right_id")).drop("rank"))
            more = met.where(common & (F.size("rest") > 0)).select(*l.columns)
            opened = more if opened is None else opened.unionByName(more)
        opened = cut(opened)
        l = cut(_hopeful(_grown(opened.drop("hope"), most).withColumn("hope", _hope(most)).where(F.col("hope") >= least), best, k))
        if l.isEmpty():
            return best
        r = _grown(r.where(F.size("rest") > 0).join(many(opened.select("key").distinct()), "key", "left_semi"), most)
        waiting, opened = None, None


def _hopeful(sets: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The sets that may come to the k-th score of their kind: those of equal score may have smaller ids."""
    full = best.groupBy("like").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).where(F.col("_n") == k).select("like", "_least")
    return sets.join(many(full), "like", "left").where(F.col("_least").isNull() | (F.col("hope") >= F.col("_least"))).drop("_least")
