"""The trie of conversations' common prefixes, built as a Patricia tree from sorted paths.

A turn is 20 bytes: 16 of a SHA-256 over role and text, and the text's length in bytes. A conversation is a path of turns, cut
into segments of SEGMENT turns; a segment hangs in the tree of the prefix before it, so no row grows with a conversation. Equal
segments are counted before they are sorted, so copies meet as one row.

Sorted paths need one stack: the common prefix with the next path says which points are done. Only branches, ends and
leaves are made, with the edge from the point above. Ranges of the sorted paths are separate tasks; a task finishes all
points but those on the paths of its first and last row, which others may share. Those few leave as partial sums and go
through the same pass again, in 1/32 as many tasks each time, until one task finishes the last. Segments that go on below
take the sums of the tree that hangs there, deepest first; a segment that one conversation alone reaches needs no
tree. Aggregates live on the compressed points; afterwards every edge is expanded into its unary nodes, by the sums of text from
each of its turns to its end, which are carried as an array.

A node's id is the hash of its path, so parents and end lists meet by equality; parents of very many children are few
and are broadcast. The list of conversations that end at a node is hashed from ranges of sorted ids, in pieces where it
leaves a range or is long, so only SHA-256 itself, which can't be split, is left to one task.

Defined results: rows of null conv_id are ignored; a null role or text is empty; turns of equal number (null first) go by a hash
of role and text; repeated rows are turns each; a conversation that is rebuilt without turns ends at the root; very long
texts leave only hash and length; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .util import batches, join_spread, own, shared_dir, stored

#: Turns of a segment, bytes of a turn, tasks whose open points meet in one, signs of a list of ids that are hashed at once.
SEGMENT, UNIT, FAN_IN, PIECE = 4096, 20, 32, 1 << 20
ROOT = bytes(16)
NOTHING = hashlib.sha256().hexdigest()
Turn = tuple[int, bytes | None]  # a conversation and the 20 bytes of one turn of it; None only says that it is there
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("level", pa.int64()), ("tree", pa.binary()), ("key", pa.binary()), ("after", pa.binary()), ("ends", pa.bool_())])
_POINTS = pa.schema(
    [("open", pa.bool_()), ("tree", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("saved", pa.int64()),
     ("depth", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("edge", pa.list_(pa.int64()))]
)
_SUMS = ["n", "conv_id", "leaves", "children", "saved"]


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def point_id(tree: bytes, key: bytes) -> bytes:
    return hashlib.sha256(tree + key).digest()[:16] if key else tree


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, unit) of each row: texts are hashed where they are read and go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = own(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.concat(digest, size).alias("unit"))


def head_of(conv_id: int, most: int = 9) -> int:
    return zlib.crc32(b"%d" % conv_id) % most


def rebuilt(turns: Iterable[tuple[int, int, bytes]], most: int = 9) -> Iterator[Turn]:
    """Turns (base, conversation, unit) by base, conversation and turn, as those of rebuilt conversations: the base's first
    turns, as many as head_of says, then the conversation's own after as many. Only those few of a base are held."""
    base, conv, heads, number, skip = None, None, [], 0, 0
    for b, c, unit in turns:
        if (b, c) != (base, conv):
            heads = heads if b == base else []
            base, conv, number, skip = b, c, 0, 0 if b == c else head_of(c, most)
            yield c, None
            yield from ((c, u) for u in heads[:skip])
        if b == c and number < most - 1:
            heads.append(unit)
        number += 1
        if number > skip:
            yield c, unit


def segments(turns: Iterable[Turn], size: int = SEGMENT) -> Iterator[dict]:
    """The segments of each conversation, whose turns come one after the other."""
    conv, level, tree, units = None, 0, ROOT, []

    def made(ends: bool) -> dict:
        key = b"".join(units)
        return {"conv_id": conv, "level": level, "tree": tree, "key": key, "after": point_id(tree, key), "ends": ends}

    for c, unit in turns:
        if c != conv:
            if conv is not None:
                yield made(True)
            conv, level, tree, units = c, 0, ROOT, []
        if unit is not None:
            if len(units) == size:
                row = made(False)
                yield row
                level, tree, units = level + 1, row["after"], []
            units.append(unit)
    if conv is not None:
        yield made(True)


def path_segments(turns: DataFrame, family: int | None = None, most: int = 9, size: int = SEGMENT) -> DataFrame:
    """The segments of all conversations of turn_rows, in the shared folder; with `family` those rebuilt from every family-th."""
    spark = turns.sparkSession
    shared_dir(spark)
    rows = turns.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family)) if family else F.col("conv_id"))
    dealt = rows.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "unit").select("base", "conv_id", "unit")

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from batches(segments(rebuilt(triples, most) if family else ((c, u) for _, c, u in triples), size), _SEGMENTS, 2000, 4 << 20, lambda r: len(r["key"]))

    return stored(dealt.mapInArrow(fold, _ddl(_SEGMENTS)), "segments")


def common_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        middle = (low + high + 1) // 2
        if a[: UNIT * middle] == b[: UNIT * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    """A point on the present path, with the sums of what is finished below it."""

    __slots__ = ("children", "conv_id", "depth", "leaves", "n", "saved")

    def __init__(self, depth: int):
        self.depth, self.n, self.conv_id, self.leaves, self.children, self.saved = depth, 0, None, 0, 0, 0

    def add(self, n: int, conv_id: int | None, leaves: int, children: int, saved: int) -> None:
        self.n, self.leaves, self.children, self.saved = self.n + n, self.leaves + leaves, self.children + children, self.saved + saved
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id


def points(rows: Iterable[tuple], last_pass: bool) -> Iterator[dict]:
    """Sorted (tree, key, n, conv_id, leaves, children, saved), prefixes first, to finished points and, unless this is the
    last pass, to open ones: those on the path of the first or the last row."""
    tree, key, stack, shared = None, b"", [], -1  # shared: turns that the present path has in common with the first row's

    def open_(p: _Point) -> dict:
        return {"open": True, "tree": tree, "key": key[: UNIT * p.depth], **{k: getattr(p, k) for k in _SUMS}}

    def finished(p: _Point, above: _Point | None) -> dict:
        top = above.depth if above else 0
        sizes = [int.from_bytes(key[UNIT * d + 16 : UNIT * d + 20]) for d in range(top, p.depth)]
        far, edge = p.saved, []
        for size in reversed(sizes):
            far += (p.n - 1) * size
            edge.append(far)
        edge = edge[::-1] or [far]
        leaves = p.leaves if p.children else 1
        if above:
            above.add(p.n, p.conv_id, leaves, 1, edge[0])
        return {
            "open": False, "tree": tree, "n": p.n, "conv_id": p.conv_id, "leaves": leaves, "children": p.children, "saved": edge[-1], "depth": p.depth,
            "id": point_id(tree, key[: UNIT * p.depth]), "parent": point_id(tree, key[: UNIT * top]) if above else None, "edge": edge,
        }

    def close(depth: int) -> Iterator[dict]:
        """Finish what is below a depth of the present path, with a point at that depth unless it is -1."""
        while stack and stack[-1].depth > depth:
            p = stack.pop()
            if depth >= 0 and stack[-1].depth < depth:
                stack.append(_Point(depth))
            yield open_(p) if p.depth <= shared and not last_pass else finished(p, stack[-1] if stack else None)

    for t, k, *sums in rows:
        if t != tree:
            yield from close(-1)
            shared = len(k) // UNIT if tree is None else -1
            tree, stack = t, [_Point(0)]
        else:
            here = common_turns(key, k)
            yield from close(here)
            shared = min(shared, here)
        key = k
        if len(k) > UNIT * stack[-1].depth:
            stack.append(_Point(len(k) // UNIT))
        stack[-1].add(*sums)
    if last_pass:
        yield from close(-1)
    else:
        yield from (open_(p) for p in stack)


def compressed(paths: DataFrame) -> DataFrame:
    """The finished points of (tree, key, n, conv_id, leaves, children, saved), a row a path."""
    tasks, found = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    rows = paths.select("tree", "key", *_SUMS)
    while True:
        dealt = (rows.repartitionByRange(tasks, "tree", "key") if tasks > 1 else rows.repartition(1)).sortWithinPartitions("tree", "key")

        def build(it: Iterator[pa.RecordBatch], last_pass: bool = tasks == 1) -> Iterator[pa.RecordBatch]:
            every = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield from batches(points(every, last_pass), _POINTS, 2000, 4 << 20, lambda r: len(r.get("key") or b"") + 8 * len(r.get("edge") or ()))

        made = stored(dealt.mapInArrow(build, _ddl(_POINTS)), "points")
        done = made.where("not open").drop("open", "key")
        found = done if found is None else found.unionByName(done)
        if tasks == 1:
            return found
        rows, tasks = made.where("open").select("tree", "key", *_SUMS), max(1, tasks // FAN_IN)


def _below(rows: DataFrame, totals: DataFrame | None) -> DataFrame:
    """Counted paths with the sums of the trees that hang at their ends."""
    counted = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("after").alias("after"))
    if totals is None:
        return counted.select("tree", "key", "n", "conv_id", *(F.lit(0).cast("long").alias(c) for c in _SUMS[2:]))
    met = counted.join(totals.select(F.col("tree").alias("after"), *_SUMS[2:]), "after", "left")
    return met.select("tree", "key", "n", "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _SUMS[2:]))


def compressed_trie(paths: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(id, parent, depth, conv_id, n, leaves, children, edge) of every branch, end and leaf; edge has the subtree sums from
    the turn after the point above to the point itself."""
    keep = ["id", "parent", "depth", "conv_id", "n", "leaves", "children", "edge"]
    deepest = paths.agg(F.max("level")).first()[0]
    if not deepest:
        return compressed(_below(paths, None)).select(*keep)
    crowd = paths.where("level > 0").groupBy("tree", "level").agg(F.count(F.lit(1)).alias("in_tree"))
    crowd = stored(crowd, "crowd")
    rest = stored(paths.where("level > 0").join(crowd.drop("level"), "tree"), "rest")
    alone = rest.where("in_tree = 1")
    turns = (F.octet_length("key") / UNIT).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    found = alone.select(
        F.col("after").alias("id"), F.col("tree").alias("parent"), (F.col("level") * size + turns).alias("depth"), "conv_id", one.alias("n"), one.alias("leaves"),
        F.when(F.col("ends"), none).otherwise(one).alias("children"), F.array_repeat(none, turns.cast("int")).alias("edge"),
    )
    single = alone.select("tree", "level", one.alias("leaves"), one.alias("children"), none.alias("saved"))
    last_shared = crowd.where("in_tree > 1").agg(F.max("level")).first()[0] or 0
    totals = single.where(F.col("level") == last_shared + 1)
    for level in range(last_shared, -1, -1):
        here = rest.where((F.col("level") == level) & (F.col("in_tree") > 1)) if level else paths.where("level = 0")
        made = compressed(_below(here, totals)).withColumn("depth", F.col("depth") + level * size)
        top = F.col("parent").isNull()
        found = found.unionByName((made.where(~top) if level else made).select(*keep))
        # the root of a tree is the end of the segment above it, which has its row there
        totals = single.where(F.col("level") == level).unionByName(made.where(top).select("tree", F.lit(level).cast("long").alias("level"), "leaves", "children", "saved"))
    return stored(found, "trie")


def end_lists(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): SHA-256 of each id's conversations, ascending, in decimal and comma-joined."""
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("id", pa.binary()), ("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.string()), ("ends_sha256", pa.string())])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            at, held, signs, piece, first = None, [], 0, 0, True

            def cut() -> dict:
                return {"id": at, "part": part, "piece": piece, "ids": ",".join(held)}

            for b in it:
                for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if node != at:
                        if at is not None:
                            # a list that may have begun in another task, or was long, leaves in pieces
                            yield cut() if first or piece else {"id": at, "ends_sha256": hashlib.sha256(",".join(held).encode()).hexdigest()}
                            first = False
                        at, held, signs, piece = node, [], 0, 0
                    held.append(str(conv))
                    signs += len(held[-1])
                    if signs >= PIECE:
                        yield cut()
                        held, signs, piece = [], 0, piece + 1
            if at is not None:
                yield cut()

        # what a cut at PIECE leaves behind may be empty, and then adds nothing
        yield from batches((r for r in rows() if r.get("ids") != ""), schema, 2000, 4 << 20, lambda r: len(r.get("ids") or ""))

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            at, sha = None, None
            for b in it:
                for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if node != at:
                        if at is not None:
                            yield {"id": at, "ends_sha256": sha.hexdigest()}
                        at, sha = node, hashlib.sha256(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
            if at is not None:
                yield {"id": at, "ends_sha256": sha.hexdigest()}

        yield from batches(rows(), pa.schema([schema.field("id"), schema.field("ends_sha256")]))

    dealt = ends.select("id", "conv_id").repartitionByRange(tasks, "id", "conv_id").sortWithinPartitions("id", "conv_id")
    lists = stored(dealt.mapInArrow(gather, _ddl(schema)), "ends")
    cuts = lists.where("ids is not null").repartition("id").sortWithinPartitions("id", "part", "piece").select("id", "ids")
    return lists.where("ids is null").select("id", "ends_sha256").unionByName(cuts.mapInArrow(join, "id binary, ends_sha256 string"))


def nodes(paths: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of path_segments' trie."""
    tree = stored(compressed_trie(paths, size), "compressed")
    below = tree.where("parent is not null")
    above = tree.where("children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("n"))
    met = join_spread(below, above, "parent", tree.count()).unionByName(tree.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    told = met.join(end_lists(paths.where("ends").select(F.col("after").alias("id"), "conv_id")), "id", "left")
    every = told.select("*", F.posexplode("edge").alias("at", "saved_tokens"))
    first, last = F.col("at") == 0, F.col("at") == F.size("edge") - 1
    return every.select(
        "conv_id", (F.col("depth") - F.size("edge") + 1 + F.col("at")).alias("depth"), F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens",
        F.when(last, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, family: int | None = None, most: int = 9, size: int = SEGMENT) -> DataFrame:
    """The nodes of all conversations, or of those rebuilt from each family's first."""
    return nodes(path_segments(turn_rows(conversations), family, most, size), size)
