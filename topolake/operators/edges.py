"""The contract graph: who produces what others require, fan-out, neighbourhoods, degrees, boundaries of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import element

from ..functions import contracts as K
from ..functions.scalars import slashes
from .shared import first_by, many


def contracts(nodes: DataFrame) -> DataFrame:
    """CONTRACT: (node_id, side, ord, raw) of every entry; ids are trimmed, rows without an id drop."""
    base = nodes.withColumn("node_id", F.trim("node_id")).where("node_id <> ''")
    sides = [base.select("node_id", F.lit(s).alias("side"), F.posexplode(s).alias("ord", "raw")) for s in ("demand", "answer")]
    return sides[0].unionByName(sides[1])


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """The first row of each trimmed id."""
    return first_by(nodes.withColumn("node_id", F.trim("node_id")).where("node_id <> ''"), ["node_id"], F.col("ord"))


def produced(nodes: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct (node_id, contract) that nodes answer."""
    key = key or (lambda c: K.key_graph(c, demand=False))
    return contracts(nodes).where("side = 'answer'").select("node_id", key(F.col("raw")).alias("contract")).where("contract is not null").distinct()


def required(nodes: DataFrame, key: Callable[[Column], Column] | None = None, last_wins: bool = True) -> DataFrame:
    """Distinct (node_id, contract) that nodes demand; of rows with one id the last counts."""
    key = key or (lambda c: K.key_graph(c, demand=True))
    if last_wins and "ord" in nodes.columns:
        nodes = first_by(nodes.withColumn("node_id", F.trim("node_id")), ["node_id"], F.desc("ord"))
    return contracts(nodes).where("side = 'demand'").select("node_id", key(F.col("raw")).alias("contract")).where("contract is not null").distinct()


def edges_of(answers: DataFrame, demands: DataFrame) -> DataFrame:
    """Distinct EDGE (src, dst, contract) from producers to consumers, self-edges included. One equi-join."""
    a = answers.select(F.col("node_id").alias("src"), "contract")
    d = demands.select(F.col("node_id").alias("dst"), "contract")
    return a.join(d, "contract").select("src", "dst", "contract")


def contract_sides(nodes: DataFrame, ignore: Iterable[str] = (), ignore_generic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(answers, demands) of NODE rows, which J1 joins."""
    return produced(nodes, lambda c: K.key_graph(c, False, ignore, ignore_generic)), required(nodes, lambda c: K.key_graph(c, True, ignore, ignore_generic))


def contract_edges(nodes: DataFrame, ignore: Iterable[str] = (), ignore_generic: bool = True) -> DataFrame:
    """J1 over NODE rows."""
    return edges_of(*contract_sides(nodes, ignore, ignore_generic))


def linked(answers: DataFrame, demands: DataFrame) -> DataFrame:
    """Distinct (node_id) at either end of J1's edges, by semi-joins of contracts: edges grow with pairs and are not made."""
    met = lambda side, other: side.join(many(other.select("contract").distinct()), "contract", "left_semi").select("node_id")
    return met(answers, demands).unionByName(met(demands, answers)).distinct()


def resync(edges: DataFrame, nodes: DataFrame, changed: DataFrame, extracted: DataFrame) -> DataFrame:
    """EDGE rows after files changed, without joining again what didn't: old edges, less those of nodes that changed files
    had or have, and those nodes' new edges on both sides.

    nodes: NODE rows with `path` of the file; changed: (path); extracted: NODE rows of the changed files as they are now. A
    node that other files declare as well is joined again from all of them.
    """
    ids = lambda df: df.select(F.trim("node_id").alias("node_id"))
    after = nodes.join(changed.select("path"), "path", "left_anti").unionByName(extracted.select(*nodes.columns))
    touched = ids(nodes.join(changed.select("path"), "path", "left_semi")).unionByName(ids(extracted)).distinct()
    answers, demands = produced(after), required(after)
    end = lambda side: touched.select(F.col("node_id").alias(side))
    kept = edges.select("src", "dst", "contract").join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti")
    out = edges_of(answers.join(touched, "node_id", "left_semi"), demands)
    into = edges_of(answers.join(touched, "node_id", "left_anti"), demands.join(touched, "node_id", "left_semi"))
    return kept.select("src", "dst", "contract").unionByName(out).unionByName(into)


def resync_contracts(answers: DataFrame, demands: DataFrame, nodes: DataFrame, changed: DataFrame, extracted: DataFrame) -> DataFrame:
    """W2 over a graph that is kept as its two sides of contracts, as its edges grow with pairs: the same edges as `resync`.

    Contracts of untouched nodes stay as they were kept, those of touched nodes are taken again, and edges are made once, as the
    result; none is stored or shuffled.
    """
    ids = lambda df: df.select(F.trim("node_id").alias("_n"))
    touched = ids(nodes.join(many(changed.select("path")), "path", "left_semi")).unionByName(ids(extracted)).distinct()
    after = nodes.join(many(changed.select("path")), "path", "left_anti").unionByName(extracted.select(*nodes.columns))
    again = contract_sides(after.join(many(touched), F.trim("node_id") == F.col("_n"), "left_semi"))
    stay = lambda side: side.select("node_id", "contract").join(many(touched), F.col("node_id") == F.col("_n"), "left_anti")
    return edges_of(*(stay(old).unionByName(new) for old, new in zip((answers, demands), again)))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return edges.select("src", "dst").distinct()


def kinds(side: DataFrame) -> DataFrame:
    """(node_id, kind) of distinct (node_id, contract): nodes with the same contracts have the same kind, and so the same others
    to meet. A kind is the number of contracts and sums of two 60-bit parts of their digests, so no node's contracts are gathered."""
    digest = F.sha2("contract", 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return side.groupBy("node_id").agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), part(1), part(16)).alias("kind"))


def _of_kinds(kind: DataFrame, side: DataFrame) -> DataFrame:
    """(kind, contract): the contracts of one node of each kind."""
    return kind.groupBy("kind").agg(F.min("node_id").alias("node_id")).join(many(side), "node_id").select("kind", "contract")


def met_kinds(a_kinds: DataFrame, answers: DataFrame, d_kinds: DataFrame, demands: DataFrame) -> DataFrame:
    """Distinct (a_kind, d_kind) of kinds that share a contract: as many as kinds lead to, however many nodes there are of each."""
    a = _of_kinds(a_kinds, answers).withColumnRenamed("kind", "a_kind")
    d = _of_kinds(d_kinds, demands).withColumnRenamed("kind", "d_kind")
    return a.join(many(d), "contract").select("a_kind", "d_kind").distinct()


def fanout(answers: DataFrame, demands: DataFrame, least: int = 1) -> DataFrame:
    """(node_id, downstream_count, downstream) over others' demands; self excluded. A list is made once for all nodes of a kind."""
    answers, demands = answers.select("node_id", "contract").distinct(), demands.select("node_id", "contract").distinct()
    a_kinds, d_kinds = kinds(answers), kinds(demands)
    ends = met_kinds(a_kinds, answers, d_kinds, demands).join(many(d_kinds.select(F.col("kind").alias("d_kind"), F.col("node_id").alias("dst"))), "d_kind")
    lists = ends.groupBy(F.col("a_kind").alias("kind")).agg(F.sort_array(F.collect_list("dst")).alias("downstream"))
    out = a_kinds.join(many(lists), "kind").select("node_id", F.array_remove("downstream", F.col("node_id")).alias("downstream"))
    return out.select("node_id", F.size("downstream").cast("long").alias("downstream_count"), "downstream").where(F.col("downstream_count") >= F.lit(max(1, least)))


def fanout_counts(answers: DataFrame, demands: DataFrame, least: int = 1) -> DataFrame:
    """J3 without the lists: (node_id, downstream_count). Kinds are counted with their nodes, so no pair of nodes is made."""
    answers, demands = answers.select("node_id", "contract").distinct(), demands.select("node_id", "contract").distinct()
    a_kinds, d_kinds = kinds(answers), kinds(demands)
    sizes = d_kinds.groupBy(F.col("kind").alias("d_kind")).agg(F.count(F.lit(1)).alias("n"))
    totals = met_kinds(a_kinds, answers, d_kinds, demands).join(many(sizes), "d_kind").groupBy(F.col("a_kind").alias("kind")).agg(F.sum("n").alias("n"))
    own = answers.join(many(demands), ["node_id", "contract"], "left_semi").select("node_id").distinct().withColumn("own", F.lit(1))
    counts = a_kinds.join(many(totals), "kind").join(many(own), "node_id", "left").select("node_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("downstream_count"))
    return counts.where(F.col("downstream_count") >= F.lit(max(1, least)))


def neighbourhood(answers: DataFrame, demands: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming) counts of distinct neighbours other than itself."""
    pairs = adjacency(edges_of(answers, demands)).where("src <> dst")
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy(F.col("x.node_id").alias("node_id")).agg(F.sum("x.o").cast("long").alias("outgoing"), F.sum("x.i").cast("long").alias("incoming"))


def degrees(edges: DataFrame) -> DataFrame:
    """A1: (node_id, in_degree, out_degree, degree); parallel edges count. One pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    out = ends.groupBy(F.col("x.node_id").alias("node_id")).agg(F.sum("x.i").cast("long").alias("in_degree"), F.sum("x.o").cast("long").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def end_degree(edges: DataFrame, primary: Column | None = None) -> DataFrame:
    """(node_id, degree, primary_degree) over both ends of edges, and of primary ones."""
    flag = primary if primary is not None else F.lit(True)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), flag.alias("p"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.count_if("p").alias("primary_degree"))


def group_boundary(answers: DataFrame, demands: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, side, contract): demands that no member answers; answers that outsiders or nobody demand.

    members: (node_id, group_id), a row a node.
    """
    g = members.select("node_id", "group_id")
    a = answers.join(g, "node_id").select("group_id", "contract").distinct()
    d = demands.join(g, "node_id").select("group_id", "contract").distinct()
    outer_demand = d.join(a, ["group_id", "contract"], "left_anti").select("group_id", F.lit("demand").alias("side"), "contract")
    # consumers of a contract: how many groups, and which if only one; nodes without a group are outsiders
    users = demands.join(g, "node_id", "left").groupBy("contract").agg(F.countDistinct(F.coalesce("group_id", F.concat(F.lit("\0"), "node_id"))).alias("n"), F.min(F.coalesce("group_id", F.lit("\0"))).alias("only"))
    kept = a.join(users, "contract", "left").where(F.col("n").isNull() | (F.col("n") > 1) | (F.col("only") != F.col("group_id")))
    return outer_demand.unionByName(kept.select("group_id", F.lit("answer").alias("side"), "contract"))


def module_id(path: Column) -> Column:
    """Module of a source path: without its ending, dots for slashes."""
    bare = F.regexp_replace(F.regexp_replace(slashes(F.trim(F.coalesce(path, F.lit("")))), r"\.[^./]+$", ""), r"^\.?/", "")
    return F.concat(F.lit("Module."), F.replace(F.when(bare == "", F.lit("root")).otherwise(bare), F.lit("/"), F.lit(".")))


def domain_id(path: Column, category: Column, prefixes: dict[str, list[str]]) -> Column:
    """Domain of a source path: category and the first segment below the category's longest prefix, else the first segment."""
    clean = F.regexp_replace(slashes(F.trim(F.coalesce(path, F.lit("")))), r"^\.?/", "")
    low, found = F.lower(clean), []
    for name, patterns in prefixes.items():
        for p in sorted((x.replace("\\", "/").removeprefix("./").lower() for x in patterns if x), key=len, reverse=True):
            rest = element(F.filter(F.split(F.substring(clean, len(p) + 1, 1 << 20), "/"), lambda x: x != ""), 1)
            found.append(F.when((category == name) & ((low == p) | low.startswith(p + "/")), F.concat(F.lit("Domain."), F.concat_ws(".", category, rest))))
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    other = F.when(F.size(parts) > 1, F.concat(F.lit("Domain."), F.concat_ws(".", category, F.get(parts, F.lit(0))))).otherwise(F.concat(F.lit("Domain."), category))
    return F.coalesce(*found, other)


def roll_up(nodes: DataFrame, group: Column, ignore: Iterable[str] = K.IGNORED_TYPES) -> DataFrame:
    """(group_id, demand, answer) of a roll-up to modules or domains; of entries with one key the first text stands."""
    rows = nodes.withColumn("group_id", group)
    texts = contracts(rows).join(rows.select(F.trim("node_id").alias("node_id"), "group_id", F.col("ord").alias("n_ord")).distinct(), "node_id")
    keyed = texts.withColumn("key", F.when(F.col("side") == "demand", K.key_rollup(F.col("raw"), True, ignore)).otherwise(K.key_rollup(F.col("raw"), False, ignore)))
    ghost = (F.col("side") == "demand") & F.trim("raw").rlike(K.GHOST_PREFIX)
    keyed = keyed.withColumn("contract", F.coalesce("key", F.when(ghost, F.concat(F.lit("ghost:"), F.trim("raw"))))).where("contract is not null")
    first = first_by(keyed, ["group_id", "side", "contract"], F.col("n_ord"), F.col("ord")).select("group_id", "side", "contract", F.trim("raw").alias("text"))
    known = keyed.where("key is not null")
    edge = group_boundary(known.where("side = 'answer'").select("node_id", "contract").distinct(), keyed.where("side = 'demand'").select("node_id", "contract").distinct(), rows.select(F.trim("node_id").alias("node_id"), "group_id").distinct())
    kept = edge.join(first, ["group_id", "side", "contract"])
    lists = kept.groupBy("group_id").agg(F.sort_array(F.collect_list(F.when(F.col("side") == "demand", F.col("text")))).alias("demand"), F.sort_array(F.collect_list(F.when(F.col("side") == "answer", F.col("text")))).alias("answer"))
    every = rows.select("group_id").distinct().join(lists, "group_id", "left")
    filled = lambda c, x: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.array(F.lit(x))).alias(c)
    return every.select("group_id", filled("demand", "None"), filled("answer", "void"))


def module_union(nodes: DataFrame, group: Column) -> DataFrame:
    """(group_id, demand, answer) as plain unions over members."""
    rows = nodes.withColumn("group_id", group)
    return rows.groupBy("group_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("demand")))).alias("demand"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("answer")))).alias("answer"))
