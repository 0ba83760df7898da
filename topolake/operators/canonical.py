"""The canonical order of a small fragment: by refined colour, then weight; nodes that agree in both are alike, and go by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def canonical_order(nodes: DataFrame, most_nodes: int = 8) -> DataFrame:
    """(owner, node_id, place, digest, mode) of fragments (owner, node_id, colour, weight).

    Fragments of at most `most_nodes` nodes are ordered strictly. Of all orders that keep colours together the least sequence
    of weights is that which sorts each colour's, so no permutation is tried, and the digest of colours and weights in that
    order is the same for all names of the nodes, however many share a colour. Larger fragments fall back to the order of
    their ids, with the digest of their weights, largest first. Fragments are never gathered beyond `most_nodes` rows.
    """
    size = nodes.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"))
    rows = nodes.select("owner", "node_id", "colour", "weight").join(size, "owner")
    few = rows.where(F.col("_n") <= most_nodes).drop("_n")
    ranked = few.withColumn("place", (F.row_number().over(Window.partitionBy("owner").orderBy("colour", "weight", "node_id")) - 1).cast("long"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("colour", "weight"))), lambda x: F.concat(F.coalesce(x["colour"], F.lit("")), F.lit(":"), x["weight"].cast("string")))
    strict = ranked.join(few.groupBy("owner").agg(F.sha2(F.array_join(texts, "|"), 256).alias("digest")), "owner").select("owner", "node_id", "place", "digest", F.lit("strict").alias("mode"))
    large = rows.where(F.col("_n") > most_nodes)
    by_weight = large.groupBy("owner", "weight").agg(F.count(F.lit(1)).alias("k")).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "k"))).alias("p"))  # a row a weight
    digest = by_weight.select("owner", F.sha2(F.array_join(F.transform("p", lambda x: F.concat((-x["w"]).cast("string"), F.lit("x"), x["k"].cast("string"))), ","), 256).alias("digest"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("node_id")) - 1
    loose = large.withColumn("place", place.cast("long")).join(digest, "owner").select("owner", "node_id", "place", "digest", F.lit("fallback").alias("mode"))
    return strict.unionByName(loose)
