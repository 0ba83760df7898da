"""The prefix trie against a plain dictionary of prefixes, over one task and many, short segments and long."""

import hashlib
import random
import zlib

import duckdb
import pytest

from topolake.llm import prefixtrie as P, queries


def plain(rows, family=5):
    """All nodes of (conv_id, turn, role, text) rows, by the contract's words."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    by = {c: [v[2:] for v in sorted(t, key=lambda v: v[:2])] for c, t in by.items()}
    paths = {}
    for c, own in by.items():
        base = c - c % family
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own if base == c else by.get(base, [])[:h] + own[h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out = []
    for n, m in members.items():
        below = [n]
        for x in below:
            below += children.get(x, [])
        ends = sorted(c for c in m if len(paths[c]) == len(n))
        out.append((
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), sum(x not in children for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, convs, longest, words=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if t > 3 else "user", r.choice("ab"[:words]) * r.randint(1, 2)) for c in range(convs) for t in range(r.randint(1, longest))]


@pytest.mark.parametrize(("size", "tasks"), [(2, 7), (3, 40), (P.SEGMENT, 1)])
def test_against_plain(spark, size, tasks):
    rows = random_rows(tasks, 120, 9)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert got(P.prefix_trie(table(spark, rows), 5, 9, size)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"line {t}") for c in range(0, 300, 5) for t in range(6)]
    rows += [(1000 + 5 * k, t, "user", f"line {t if t < 40 else t + k}") for k in range(3) for t in range(60)]
    rows += [(2000, t, "user", f"other {t}") for t in range(50)]
    for size in (7, P.SEGMENT):
        assert got(P.prefix_trie(table(spark, rows), 5, 9, size)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "never seen"), (5, None, None, "first"), (5, 1, "user", None), (5, 2, None, None), (6, 1, "user", "own"), (7, 1, "user", "x"), (7, 2, "user", "y"),
        (12, 3, "user", "no base"), (12, 4, "assistant", "still none"), (10**12 + 1, 1, "ab", "c"), (10**12 + 6, 1, "a", "bc"), (15, 1, "user", "ä" * 3), (16, 1, "user", "z" * 200_000),
        *((20, 1, "user", "again") for _ in range(3)),
    ]
    df = table(spark, rows).selectExpr("*", "'x' as tree", "1 as n", "2 as level")
    assert got(P.prefix_trie(df, 5)) == plain(rows)


def test_empty_table(spark):
    assert got(P.prefix_trie(table(spark, []), 5)) == []


def test_long_lists_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(0, 400_000, 5)]
    assert got(P.prefix_trie(table(spark, rows).repartition(8), 5)) == plain(rows)


def test_points_of_any_cut_agree():
    """Finished and open points of two passes, however the sorted paths are cut, are those of one pass."""
    r = random.Random(5)
    keys = sorted({b"".join(bytes([r.choice(b"ab")]) * 16 + (r.choice([1, 2])).to_bytes(4) for _ in range(r.randint(0, 6))) for _ in range(60)})
    rows = [(bytes(16), k, 1 + i % 3, i, 0, 0, 0) for i, k in enumerate(keys)]
    whole = sorted(map(str, P.points(rows, True)))
    for cut in range(len(rows) + 1):
        found = [x for part in (rows[:cut], rows[cut:]) for x in P.points(part, False)]
        again = sorted((tuple(x[c] for c in ["tree", "key", *P._SUMS]) for x in found if x["open"]), key=lambda x: x[:2])
        assert sorted(map(str, [x for x in found if not x["open"]] + list(P.points(again, True)))) == whole


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(queries.ORACLE["op13_prefixtrie"])
    rows = sorted((tuple(r) for r in want.fetchall()), key=str)
    assert got(queries.op13_prefixtrie(spark, "/root/testdata/sf0.01")) == rows and len(rows) > 100
