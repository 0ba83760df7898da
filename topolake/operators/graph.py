"""Graph queries as fix-point loops of joins: closure, components, levels, weights, fingerprints, traces, colours.

Joins of a loop's tables are by shuffles (`many`), so no table of nodes or edges goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import runtime_id
from .shared import many, spread_top_by, written as cut

def _spread(ways: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, word, bits): all bits that reach a node over ways (a, b) from seeds (node, word, bits), by one step or more.

    A round sends what is new over the ways, 64 sources to a long; one aggregation ors what arrives with what was there.
    """
    ways = cut(ways.select("a", "b").distinct())
    known, news = None, seeds
    while True:
        came = news.join(many(ways), F.col("node") == F.col("a")).select(F.col("b").alias("node"), "word", "bits", F.lit(0).cast("long").alias("old"))
        every = came if known is None else came.unionByName(known.select("node", "word", "bits", F.col("bits").alias("old")))
        known = cut(every.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")))
        news = known.where("bits <> old").select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits"))
        if news.isEmpty():
            return known.drop("old")


def _numbered(nodes: DataFrame) -> DataFrame:
    """(node, word, bits): each node has one bit of a word of 64; words are filled by each task for itself."""
    every = cut(nodes.select(F.col("node_id").alias("node")).distinct().withColumn("_n", F.monotonically_increasing_id()))
    return every.select("node", F.shiftright("_n", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))


def _doubled(pairs: DataFrame, starts: DataFrame, most: int = 16) -> DataFrame | None:
    """(a, b, d): all pairs that lead to each other over (src, dst) by one step or more, and by how few, in rounds that are the
    logarithm of the longest such way; None where that would be more work than a search step by step.

    A pair at a distance over k and up to 2k has a node on its way at k exactly, so a round joins the pairs at k with all that
    are known, and each pair is found about once. Where ways are many (a round would make over `most` times as many pairs as
    there are), or starts are few, it gives up.
    """
    known, k = cut(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("d")).distinct()), 1
    heads = known.select(F.col("a").alias("node_id")).distinct()
    if 4 * heads.join(many(starts.select("node_id").distinct()), "node_id", "left_semi").count() < heads.count():
        return None
    while True:
        last = known.where(F.col("d") == k)
        sizes = last.groupBy(F.col("b").alias("m")).agg(F.count(F.lit(1)).alias("n")).join(many(known.groupBy(F.col("a").alias("m")).agg(F.count(F.lit(1)).alias("o"))), "m")
        made = sizes.agg(F.sum(F.col("n") * F.col("o"))).first()[0]
        if not made:
            return known
        if made > most * known.count():
            return None
        further = last.select("a", F.col("b").alias("m")).join(many(known.select(F.col("a").alias("m"), "b", (F.col("d") + k).alias("d"))), "m").select("a", "b", "d")
        known, k = cut(known.unionByName(further).groupBy("a", "b").agg(F.min("d").alias("d"))), 2 * k


def reach(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct (origin, node) reachable from each start over (src, dst) by one step or more; cycles may return to it.

    Where all search and what they reach is little, ways are doubled. Else the search holds a bit for each start, and pairs are
    only made of its result.
    """
    pairs = cut(pairs.select("src", "dst").distinct())
    if (near := _doubled(pairs, starts)) is not None:
        return near.select(F.col("a").alias("origin"), F.col("b").alias("node")).join(many(starts.select(F.col("node_id").alias("origin")).distinct()), "origin", "left_semi")
    seeds = _numbered(starts)
    found = _spread(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), seeds)
    return found.join(many(seeds.select("word", F.col("node").alias("origin"), F.col("bits").alias("bit"))), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("origin", "node")


def impact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(origin, impacted): how many other nodes each node reaches over (src, dst).

    Where what nodes reach is little, ways are doubled and counted. Else no pair is made: each node's bit goes against the edges, so what has come to a node are the nodes that it reaches; they are counted by words.
    """
    pairs = cut(pairs.select("src", "dst").distinct())
    ids = nodes.select(F.col("node_id").alias("origin")).distinct()
    if (near := _doubled(pairs, pairs.select(F.col("src").alias("node_id")))) is not None:
        counts = near.where("a <> b").groupBy("a").agg(F.count(F.lit(1)).alias("impacted"))
        return ids.join(many(counts), F.col("origin") == F.col("a"), "left").select("origin", F.coalesce("impacted", F.lit(0).cast("long")).alias("impacted"))
    seeds = _numbered(pairs.select(F.explode(F.array("src", "dst")).alias("node_id")))
    found = _spread(pairs.select(F.col("dst").alias("a"), F.col("src").alias("b")), seeds)
    own = seeds.select("node", "word", F.col("bits").alias("own"))
    others = found.join(many(own), ["node", "word"], "left").select("node", F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long"))))).alias("n"))
    counts = others.groupBy("node").agg(F.sum("n").alias("impacted"))
    return ids.join(many(counts), F.col("origin") == F.col("node"), "left").select("origin", F.coalesce("impacted", F.lit(0).cast("long")).alias("impacted"))


def blast_radius(pairs: DataFrame, starts: DataFrame, is_contract_change: bool = True) -> DataFrame:
    """G1: (origin, node) impacted by a contract change, origins themselves excluded; nothing for other changes."""
    found = reach(pairs, starts).where("origin <> node")
    return found if is_contract_change else found.limit(0)


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Nodes with one edge in and one out, by pointer jumping: (node_id, head, tail), the ends of a node's chain, and
    (node_id, component) where such nodes form a ring; None if there are none. Rounds are the logarithm of their number.
    """
    ways = lambda a, b: edges.groupBy(F.col(a).alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min(b).alias(b)).where("n = 1").select("node_id", b)
    inner = cut(ways("src", "dst").join(many(ways("dst", "src")), "node_id").select("node_id", F.col("src").alias("head"), F.col("dst").alias("tail"), F.col("node_id").alias("least"), F.lit(True).alias("open")))
    size = inner.count()
    if not size:
        return None
    for _ in range(size.bit_length()):
        on = inner.select(F.col("node_id").alias("tail"), F.col("tail").alias("tail2"), F.col("least").alias("least2"))
        back = inner.select(F.col("node_id").alias("head"), F.col("head").alias("head2"))
        met = inner.join(many(on), "tail", "left").join(many(back), "head", "left")
        inner = cut(met.select("node_id", F.coalesce("head2", "head").alias("head"), F.coalesce("tail2", "tail").alias("tail"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("tail2").isNotNull() | F.col("head2").isNotNull()).alias("open")))
        if inner.where("open").isEmpty():
            break
    # after so many rounds only rings still lead to nodes with one edge in and one out
    ring = many(inner.select(F.col("node_id").alias("tail")))
    return inner.join(ring, "tail", "left_anti").select("node_id", "head", "tail"), inner.join(ring, "tail", "left_semi").select("node_id", F.col("least").alias("component"))


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component) of strongly connected components, named by their least node.

    Nodes without a predecessor or successor left are components of their own. Chains of nodes with one edge in and one out
    become one edge, by pointer jumping; its nodes belong to the component of the chain's ends if both ends have the same
    one. Trees and chains are gone after rounds that grow with the logarithm of their size. In what stays, every node takes
    the largest name that reaches it as its colour, all roots at once, and of each colour what reaches its root backward is
    one component. No closure of pairs is built.
    """
    live = cut(nodes.select("node_id").distinct())
    edges = cut(known_edges(pairs.select("src", "dst").distinct().where("src <> dst"), live))
    done, chains = live.select("node_id", F.col("node_id").alias("component")).limit(0), []
    while True:
        while not edges.isEmpty():
            # trim
            ends = edges.select(F.col("src").alias("node_id"), F.lit(0).alias("side")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("side")))
            both = ends.groupBy("node_id").agg((F.min("side") < F.max("side")).alias("both"))
            marked = cut(live.join(many(both), "node_id", "left").select("node_id", F.coalesce("both", F.lit(False)).alias("both")))
            live, off = marked.where("both").select("node_id"), marked.where("not both").select("node_id")
            done = done.unionByName(off.select("node_id", F.col("node_id").alias("component")))
            trimmed = not off.isEmpty()
            if trimmed:
                edges = cut(known_edges(edges, live))
            # chains
            found = _chains(edges)
            if found is None:
                if not trimmed:
                    break
                continue
            inner, rings = (cut(x) for x in found)
            chains.append(inner)
            done = done.unionByName(rings)
            live = cut(live.join(many(inner), "node_id", "left_anti").join(many(rings), "node_id", "left_anti"))
            edges = cut(known_edges(edges, live).unionByName(inner.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).where("src <> dst").distinct())
        if edges.isEmpty():
            done = done.unionByName(live.select("node_id", F.col("node_id").alias("component")))
            break
        # colour: each node takes the greatest name that reaches it; only nodes whose colour changed send it on
        colour = live.select("node_id", F.col("node_id").alias("colour"), F.lit(True).alias("fresh"))
        while True:
            best = edges.join(many(colour.where("fresh").select(F.col("node_id").alias("src"), "colour")), "src").groupBy(F.col("dst").alias("_to")).agg(F.max("colour").alias("c"))
            colour = cut(colour.join(many(best), F.col("node_id") == F.col("_to"), "left").select("node_id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), F.coalesce(F.col("c") > F.col("colour"), F.lit(False)).alias("fresh")))
            if colour.where("fresh").isEmpty():
                break
        colour = colour.drop("fresh")
        # backward from each root within its colour
        found = frontier = cut(colour.where("node_id = colour"))
        cs, cd = colour.select(F.col("node_id").alias("src"), F.col("colour").alias("cs")), colour.select(F.col("node_id").alias("dst"), F.col("colour").alias("cd"))
        same = cut(edges.join(many(cs), "src").join(many(cd), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("_colour")))
        while True:
            known = frontier.select(F.col("node_id").alias("dst"), F.col("colour").alias("_colour"))
            new = same.join(many(known), ["dst", "_colour"]).select(F.col("src").alias("node_id"), F.col("_colour").alias("colour")).distinct()
            new = cut(new.join(many(found.select("node_id")), "node_id", "left_anti"))
            if new.isEmpty():
                break
            found, frontier = cut(found.unionByName(new)), new
        done = cut(done.unionByName(found.select("node_id", F.col("colour").alias("component"))))
        live = cut(live.join(many(found), "node_id", "left_anti"))
        edges = cut(known_edges(edges, live))
    for inner in reversed(chains):
        ends = lambda side: many(done.select(F.col("node_id").alias(side), F.col("component").alias(f"{side}_in")))  # noqa: B023, E731
        own = inner.join(ends("head"), "head").join(ends("tail"), "tail").select("node_id", F.when(F.col("head_in") == F.col("tail_in"), F.col("head_in")).otherwise(F.col("node_id")).alias("component"))
        done = cut(done.unionByName(own))
    return cut(done.join(many(done.groupBy("component").agg(F.min("node_id").alias("least"))), "component").select("node_id", F.col("least").alias("component")))


def cycles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, members, signature) of components of two nodes or more, and of nodes with an edge to themselves."""
    comp = components(pairs, nodes)
    loops = pairs.where("src = dst").select(F.col("src").alias("node_id")).distinct().withColumn("loop", F.lit(True))
    found = comp.join(many(loops), "node_id", "left").groupBy("component").agg(F.sort_array(F.collect_list("node_id")).alias("members"), F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop"))
    return found.where((F.col("n") > 1) | F.col("loop")).select("component", "members", F.array_join("members", " -> ").alias("signature"))


def contract_cycles(answers: DataFrame, demands: DataFrame, ids: DataFrame) -> DataFrame:
    """(component, members, blast) of cycles of two nodes or more, through nodes of `ids`: their nodes, and how many others they reach.

    Nodes with the same contracts on both sides are one vertex, and contracts are vertices between them, so the graph has as
    many edges as there are kinds of nodes and their contracts, and no pair of a producer and a consumer is made. What a cycle
    reaches is counted over the graph of components.
    """
    from .edges import kinds

    sides = [x.select("node_id", "contract").distinct() for x in (answers, demands)]
    a, d = (kinds(x).withColumnRenamed("kind", c) for x, c in zip(sides, "ad"))
    told = ids.select("node_id").distinct().withColumn("known", F.lit(True))
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in "ad"]
    of = cut(a.join(many(d), "node_id", "full").join(many(told), "node_id", "left").select("node_id", *filled, F.coalesce("known", F.lit(False)).alias("known")))
    vertex = cut(of.groupBy("a", "d", "known").agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n")))
    of_node, of_contract = F.concat(F.lit("n"), "node_id"), F.concat(F.lit("c"), "contract")
    out, in_ = (x.join(many(vertex), "node_id") for x in sides)
    edges = cut(out.select(of_node.alias("src"), of_contract.alias("dst"), "known").unionByName(in_.select(of_contract.alias("src"), of_node.alias("dst"), "known")))
    comp = components(edges.where("known"), edges.select(F.explode(F.array("src", "dst")).alias("node_id")))
    sized = comp.join(many(vertex.select(of_node.alias("node_id"), "n", "a", "d", "known")), "node_id", "left")
    found = cut(sized.groupBy("component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("vertices")))
    loops = found.where("vertices > 1 and n > 1").select("component")
    members = sized.where("n is not null").join(many(loops), "component", "left_semi").select("component", "a", "d", "known").join(many(of), ["a", "d", "known"]).groupBy("component").agg(F.sort_array(F.collect_list("node_id")).alias("members"))
    end = lambda side: many(comp.select(F.col("node_id").alias(side), F.col("component").alias(f"{side}_in")))
    between = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_in <> dst_in").select(F.col("src_in").alias("src"), F.col("dst_in").alias("dst"))
    hit = reach(between, loops.withColumnRenamed("component", "node_id")).where("origin <> node")
    blast = hit.join(many(found.select(F.col("component").alias("node"), "n")), "node").groupBy(F.col("origin").alias("component")).agg(F.sum("n").alias("blast"))
    return members.join(many(blast), "component", "left").select("component", "members", F.coalesce("blast", F.lit(0).cast("long")).alias("blast"))


def collapse(pairs: DataFrame, nodes: DataFrame, answers: DataFrame, demands: DataFrame) -> DataFrame:
    """(macro_id, members, demand, answer): one node for each cycle, with the contracts that cross its boundary."""
    from .edges import group_boundary

    found = cycles(pairs, nodes)
    outer = group_boundary(answers, demands, found.select(F.col("component").alias("group_id"), F.explode("members").alias("node_id")))
    side = lambda s: F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("contract")))).alias(s)
    lists = outer.groupBy("group_id").agg(side("demand"), side("answer"))
    names = F.filter(F.transform("members", lambda m: F.regexp_replace(F.regexp_replace(m, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")), lambda x: x != "")
    none = F.array().cast("array<string>")
    return found.join(lists, found.component == lists.group_id, "left").select(F.concat(F.lit("MacroNode."), F.when(F.size(names) > 0, F.array_join(names, "__")).otherwise("Cycle")).alias("macro_id"), "members", F.coalesce("demand", none).alias("demand"), F.coalesce("answer", none).alias("answer"))


def longest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest path that leads to each node of an acyclic graph (src, dst) over nodes (node).

    Nodes without edges in are done, and raise what they lead to. A node with one edge in has max(b, x + c) of its
    predecessor's level x, and such functions compose, so by pointer jumping all of them come to depend on nodes with more
    edges in, in rounds that grow with the logarithm of the longest such path; they wait until those are known.
    """
    base = cut(nodes.select("node", F.lit(0).alias("b")))
    edges = cut(edges.select("src", "dst").distinct().withColumn("w", F.lit(1)))
    level, waiting = base.select("node", F.col("b").alias("level")).limit(0), []

    def raised(base: DataFrame, by: DataFrame) -> DataFrame:
        most = by.groupBy(F.col("dst").alias("node")).agg(F.max("least").alias("least"))
        return base.join(many(most), "node", "left").select("node", F.greatest("b", F.coalesce("least", "b")).alias("b"))

    while not base.isEmpty():
        ones = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up"), F.max("w").alias("c")).where("n = 1").join(many(base), "node").select("node", "up", "b", "c")
        ones = cut(ones)
        if not ones.isEmpty():
            while True:
                above = ones.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("b").alias("b2"), F.col("c").alias("c2"))
                met = ones.join(many(above), "up", "left")
                ones = cut(met.select("node", F.coalesce("up2", "up").alias("up"), F.greatest("b", F.coalesce(F.col("b2") + F.col("c"), "b")).alias("b"), (F.col("c") + F.coalesce("c2", F.lit(0))).alias("c"), F.col("up2").isNotNull().alias("open")))
                if ones.where("open").isEmpty():
                    break
            waiting.append(ones)
            gone = ones.select(F.col("node").alias("dst"))
            rest = edges.join(many(gone), "dst", "left_anti").join(many(ones.select(F.col("node").alias("src"), "up", F.col("b").alias("b2"), F.col("c").alias("c2"))), "src", "left")
            rest = cut(rest.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("c2", F.lit(0))).alias("w"), (F.col("w") + F.coalesce("b2", F.lit(0))).alias("least")))
            base = raised(base.join(many(ones.select("node")), "node", "left_anti"), rest)
            edges = cut(rest.groupBy("src", "dst").agg(F.max("w").alias("w")))
        fed = edges.select(F.col("dst").alias("node")).distinct().withColumn("fed", F.lit(True))
        marked = cut(base.join(many(fed), "node", "left").select("node", "b", F.coalesce("fed", F.lit(False)).alias("fed")))
        first = marked.where("not fed").select("node", "b")
        level = level.unionByName(first.select("node", F.col("b").alias("level")))
        sent = cut(edges.join(many(first.select(F.col("node").alias("src"), "b")), "src", "left").select("src", "dst", "w", "b"))
        base = cut(raised(marked.where("fed").select("node", "b"), sent.where("b is not null").select("dst", (F.col("b") + F.col("w")).alias("least"))))
        edges = sent.where("b is null").select("src", "dst", "w")
    for ones in reversed(waiting):
        own = ones.join(many(level.select(F.col("node").alias("up"), "level")), "up").select("node", F.greatest("b", F.col("level") + F.col("c")).alias("level"))
        level = cut(level.unionByName(own))
    return level


def levels(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(node_id, component, level): longest path of components that leads to each."""
    a, b = comp.select(F.col("node_id").alias("src"), F.col("component").alias("cs")), comp.select(F.col("node_id").alias("dst"), F.col("component").alias("cd"))
    dag = pairs.join(many(a), "src").join(many(b), "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst"))
    level = longest_paths(dag, comp.select(F.col("component").alias("node")).distinct())
    return comp.join(many(level), F.col("component") == F.col("node")).select("node_id", "component", "level")


def weights(answers: DataFrame, demands: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, weight): 1 + demands that someone answers + answers that someone demands + edges in + distinct successors."""
    met = demands.join(answers.select("contract").distinct(), "contract", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("a"))
    used = answers.join(demands.select("contract").distinct(), "contract", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("b"))
    in_ = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("c"))
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    every = nodes.select("node_id").distinct()
    for part in (met, used, in_, out):
        every = every.join(part, "node_id", "left")
    return every.select("node_id", (F.lit(1) + sum((F.coalesce(c, F.lit(0)) for c in "abcd"), F.lit(0))).cast("long").alias("weight"))


def partition(levelled: DataFrame, weighed: DataFrame) -> DataFrame:
    """One row (partition): for each level the weight at it and above, zeros dropped; non-increasing."""
    by = levelled.join(weighed, "node_id").groupBy("level").agg(F.sum("weight").alias("w"))
    tail = by.withColumn("s", F.sum("w").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)))  # one row a level
    return tail.where("s > 0").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "s"))), lambda x: x["s"]).alias("partition"))


def boundary_word(parts: Column) -> Column:
    """The partition's boundary as bits: read backwards, as many zeros as each part gains, then a one."""
    rows = F.reverse(parts)
    gain = F.transform(rows, lambda x, i: F.array_append(F.array_repeat(F.lit(0), (x - F.when(i > 0, F.get(rows, i - 1)).otherwise(0)).cast("int")), F.lit(1)))
    return F.flatten(gain)


def boundary_hash(bits: Column) -> Column:
    """Short hash of the boundary's length and bits."""
    text = F.concat(F.lit("maya:"), F.size(bits).cast("string"), F.lit(":"), F.array_join(bits.cast("array<string>"), ""))
    return F.concat(F.lit("Maya-ID: 0x"), F.upper(F.left(F.sha2(text, 256), F.lit(8))))


def colours(pairs: DataFrame, base: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node_id, colour) after colour refinement of (node_id, colour) over in- and out-neighbours.

    A round hashes a node's colour with the multiset of colours on either side, as sums of two 60-bit parts of each, so a
    hub's neighbours are added up where they are; it stops when no class splits any more.
    """
    edges = cut(pairs.select("src", "dst").distinct())
    now = cut(base.select("node_id", F.sha2("colour", 256).alias("colour")))
    classes, done = now.select("colour").distinct().count(), 0
    while rounds is None or done < rounds:
        part = lambda at: F.sum(F.conv(F.substring("colour", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        sums = F.concat_ws(",", part(1), part(16))
        out = edges.join(many(now), edges.dst == now.node_id).groupBy(F.col("src").alias("o")).agg(sums.alias("oc"))
        in_ = edges.join(many(now), edges.src == now.node_id).groupBy(F.col("dst").alias("i")).agg(sums.alias("ic"))
        text = F.concat_ws("|", "colour", F.concat(F.lit("o"), F.coalesce("oc", F.lit(""))), F.concat(F.lit("i"), F.coalesce("ic", F.lit(""))))
        now = cut(now.join(many(out), now.node_id == out.o, "left").join(many(in_), F.col("node_id") == in_.i, "left").select("node_id", F.sha2(text, 256).alias("colour")))
        done += 1
        got = now.select("colour").distinct().count()
        if got == classes:
            break
        classes = got
    return now


def trace(edges: DataFrame, start: str, direction: str = "both", depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within `depth` steps of a start, up, down or both ways; the plan is `depth` joins, no loop over data.

    edges: (id, src, dst). Depth 0 gives the start alone. The caller knows that the start exists.
    """
    spark = edges.sparkSession
    steps = []
    if direction in ("downstream", "both"):
        steps.append(edges.select("id", F.col("src").alias("a"), F.col("dst").alias("b")))
    if direction in ("upstream", "both"):
        steps.append(edges.select("id", F.col("dst").alias("a"), F.col("src").alias("b")))
    ways = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    nodes = frontier = spark.createDataFrame([(start,)], "node_id string")
    found = edges.select("id").limit(0)
    for _ in range(depth):
        hit = frontier.join(ways, frontier.node_id == ways.a)
        found = found.unionByName(hit.select("id"))
        frontier = hit.select(F.col("b").alias("node_id")).distinct()
        nodes = nodes.unionByName(frontier)
    return nodes.distinct(), found.distinct()


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with both ends known; two semi-joins."""
    ids = many(nodes.select(F.col("node_id").alias("_n")).distinct())
    return edges.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")


def index_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Known edges, each with an id, made from its ends and type where it has none."""
    made = runtime_id(F.concat_ws(".", F.lit("RuntimeEdge"), "src", "type", "dst"))
    return known_edges(edges, nodes).withColumn("id", F.coalesce("id", made))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, type) for ends of edges without a node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").withColumn("type", F.lit("UnknownRuntime"))


def filter_graph(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, ids: DataFrame | None = None, query: str = "", edge_types: list[str] | None = None, hide_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes by type, id and words in their columns, the edges between them by type, and no isolated nodes if asked."""
    kept = nodes
    if node_types is not None:
        kept = kept.where(F.col("type").isin(node_types))
    if ids is not None:
        kept = kept.join(ids.select("node_id"), "node_id", "left_semi")
    if query.strip():
        text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("node_id", "label", "type", "source_path", "framework") if c in nodes.columns)))
        kept = kept.where(text.contains(query.strip().lower()))
    inner = known_edges(edges, kept)
    if edge_types is not None:
        inner = inner.where(F.col("type").isin(edge_types))
    if hide_isolated:
        ends = inner.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        kept = kept.join(ends, "node_id", "left_semi")
    return kept, inner


def by_view(nodes: DataFrame, edges: DataFrame, types: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """nodes of a view's types and the edges between them; no types is the full view."""
    if types is None:
        return nodes, edges
    kept = nodes.where(F.col("type").isin(types))
    return kept, known_edges(edges, kept)


def cap_edges(edges: DataFrame, most: int | None) -> DataFrame:
    """The most confident edges; all without a cap."""
    return edges if not most else edges.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "id").limit(max(1, most))


def dense_cap(edges: DataFrame, nodes: DataFrame, resource_types: list[str], most: int, dense: int = 12) -> DataFrame:
    """Of each resource with `dense` edges or more only its `most` most confident ones; other edges all stay."""
    resources = nodes.where(F.col("type").isin(resource_types)).select("node_id")
    ends = edges.select("id", "confidence", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id")).join(resources, "node_id", "left_semi")
    full = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dense).select("node_id")
    ends = ends.join(full, "node_id", "left_semi")
    kept = spread_top_by(ends, "node_id", most, F.col("id"), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("id"))
    gone = ends.join(kept.select("node_id", "id"), ["node_id", "id"], "left_anti").select("id").distinct()
    return edges.join(gone, "id", "left_anti")
