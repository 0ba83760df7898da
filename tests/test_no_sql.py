"""Queries that SQL cannot say, against plain versions on the smallest tables."""

import hashlib
from collections import defaultdict
from itertools import permutations

import __spark_entry__ as entry
from topolake.operators import advice
from topolake.plans import derive as D
from topolake.sources.config import AutoRun

SF = "/root/testdata/sf0.001"


def test_gated_runs(spark):
    """Each project's events in order through the gates, written out."""
    cfg, want, state = AutoRun(), {}, defaultdict(lambda: {"pending": 0, "run": None, "scan": None})
    known = {t.lower() for t in cfg.triggers}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        trigger, now = {"view": "sync", "click": "verify"}.get(r["event_type"], "other"), r["ts"].timestamp()
        s = state[r["user_id"] % 10]
        s["pending"] += 1
        if not cfg.enabled or not cfg.auto_trigger:
            reason = "disabled" if not cfg.enabled else "auto_disabled"
        elif known and trigger not in known:
            reason = "trigger_not_listed"
        elif s["pending"] < cfg.min_events:
            reason = "event_gate"
        elif s["run"] is not None and now - s["run"] < 3600 * cfg.min_hours:
            reason = "time_gate"
        elif s["scan"] is not None and now - s["scan"] < 60 * cfg.throttle_minutes:
            reason = "scan_throttle"
        else:
            reason, s["pending"], s["run"], s["scan"] = "completed", 0, now, now
        want[r["event_id"]] = (str(r["user_id"] % 10), trigger, "run" if reason == "completed" else "skipped", reason, s["pending"])
    got = {r["event_id"]: (r["project"], r["trigger"], r["status"], r["reason"], r["pending"]) for r in entry.queries()["w3_gated_runs"](spark, SF).collect()}
    assert got == want


def test_canonical_order(spark):
    """Small fragments: the least of all orders by colour; large ones: by id."""
    fragments = defaultdict(list)
    for r in D.parts(spark, SF).collect():
        fragments[r["node_id"].split(".")[0]].append((str(len(r["demand"])), len(r["answer"]), r["node_id"]))
    got = defaultdict(list)
    for r in entry.queries()["g11_canonical_order"](spark, SF).collect():
        got[r["owner"]].append((r["place"], r["node_id"], r["digest"], r["mode"]))
    assert set(got) == set(fragments)
    for owner, rows in fragments.items():
        assert len(rows) <= 8 and {m for *_, m in got[owner]} == {"strict"}
        orders = (p for p in permutations(rows) if [c for c, _, _ in p] == sorted(c for c, _, _ in rows)) if len(rows) <= 7 else ()
        best = min(orders, key=lambda p: (tuple((w, c) for c, w, _ in p), tuple(n for _, _, n in p)))
        assert [n for _, n, _, _ in sorted(got[owner])] == [n for _, _, n in best]
        assert {d for *_, d, _ in got[owner]} == {hashlib.sha256("|".join(f"{c}:{w}" for c, w, _ in best).encode()).hexdigest()}


def test_canonical_order_falls_back(spark):
    from topolake.operators import canonical

    rows = [("big", f"n{i:02}", "x", i % 3) for i in range(20)] + [("small", "a", "x", 1), ("small", "b", "w", 2)]
    got = canonical.canonical_order(spark.createDataFrame(rows, "owner string, node_id string, colour string, weight int")).collect()
    assert len(got) == 22 and {(r["owner"], r["mode"]) for r in got} == {("big", "fallback"), ("small", "strict")}
    assert [r["node_id"] for r in sorted((r for r in got if r["owner"] == "big"), key=lambda r: r["place"])] == [f"n{i:02}" for i in range(20)]
    assert [r["node_id"] for r in sorted((r for r in got if r["owner"] == "small"), key=lambda r: r["place"])] == ["b", "a"]


def test_restructure(spark):
    """Cycles, fat nodes and pieces of one file, from the nodes' contracts alone."""
    import re

    nodes = D.parts(spark, SF).collect()
    answers, demands = defaultdict(set), defaultdict(set)
    for r in nodes:
        for x in r["answer"]:
            if x != "void":
                answers[x].add(r["node_id"])
        for x in r["demand"]:
            if not x.startswith("[Ghost") and x != "None" and not x.startswith("string"):
                demands[x.split("(")[0].strip()].add(r["node_id"])
    after = defaultdict(set)
    for c, producers in answers.items():
        for a in producers:
            after[a] |= demands[c]

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for b in after[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    hit = {r["node_id"]: reached(r["node_id"]) for r in nodes}
    loops = {frozenset(b for b in hit[a] if a in hit[b]) for a in hit if a in hit[a]}
    want = set()
    for m in loops:
        if len(m) >= 2:
            outer = set().union(*(hit[a] for a in m)) - m
            want.add(("renormalize", min(m), 1000 + 20 * len(m) + len(outer)))
    fan = {a: len(after[a] - {a}) for a in hit}
    problem = {r["node_id"]: r["problem"] for r in nodes}
    for a, n in fan.items():
        if n >= 6:
            want.add(("split", a, 500 + 10 * n + (25 if re.search(advice.ORCHESTRATION, a) or re.search(advice.ORCHESTRATION, problem[a]) else 0)))
    groups = defaultdict(list)
    for a in hit:
        groups[a.split(".")[0]].append(a)
    for g, members in groups.items():
        helpers, mean = sum(bool(re.search(advice.FRAGMENT, a.split(".")[1])) for a in members), sum(fan[a] for a in members) / len(members)
        if len(members) >= 3 and (helpers or mean <= 1.5):
            want.add(("aggregate", f"{g}@src/all.ts", 200 + 10 * len(members) + 6 * helpers + max(0, 5 - int(mean + 0.5))))
    got = entry.queries()["c9_restructure"](spark, SF).collect()
    assert {(r["operation"], r["target"], r["score"]) for r in got} == want
    assert [(-r["score"], r["target"]) for r in got] == sorted((-r["score"], r["target"]) for r in got)
