"""Streams: gated automatic runs, watched files and periodic ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..ship import ship
from ..operators.governance import fingerprints, manifest_diff
from ..sources.config import AutoRun

STATE = "total long, pending long, last_run double, last_scan double"
DECISION = "project string, event_id long, trigger string, status string, reason string, pending long"


def decide(state: tuple, trigger: str, now: float, cfg: AutoRun, force: bool = False, fails: bool = False) -> tuple[tuple, str, str]:
    """The next state, the status and the reason of one event at `now` (seconds).

    Counters rise before any gate. Gates in order: enabled, automatic, listed trigger, events, hours, throttle. A run
    empties the pending events; a failed one only counts as a scan. Missing times block nothing.
    """
    total, pending, last_run, last_scan = state
    total, pending = total + 1, pending + 1
    known = [t.strip().lower() for t in cfg.triggers if t.strip()]
    reason = None
    if not force:
        if not cfg.enabled:
            reason = "disabled"
        elif not cfg.auto_trigger:
            reason = "auto_disabled"
        elif known and trigger.lower() not in known:
            reason = "trigger_not_listed"
        elif pending < cfg.min_events:
            reason = "event_gate"
        elif last_run is not None and (now - last_run) / 3600 < cfg.min_hours:
            reason = "time_gate"
        elif last_scan is not None and (now - last_scan) / 60 < cfg.throttle_minutes:
            reason = "scan_throttle"
    if reason:
        return (total, pending, last_run, last_scan), "skipped", reason
    if fails:
        return (total, pending, last_run, now), "error", "run_failed"
    return (total, 0, now, now), "run", "completed"


def gated(events: DataFrame, config: AutoRun | None = None) -> DataFrame:
    """W3 over a stream of (project, event_id, trigger, ts): a decision a row, with one state a project.

    Time comes with the events, so a rerun decides the same. Within a batch a project's events go in order of (ts,
    event_id), so their ids, triggers and times are held until all of a batch have come; the source's limits on files or
    rows a batch bound that. Decisions leave in parts.
    """
    ship(events.sparkSession)
    cfg = config or AutoRun()

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, None, None)
        parts = [c[["event_id", "trigger", "ts"]].astype({"trigger": "category"}) for c in chunks]
        for part in parts:
            part["trigger"] = part["trigger"].cat.set_categories(sorted({t for p in parts for t in p["trigger"].cat.categories}))
        held, out = pd.concat(parts, ignore_index=True).sort_values(["ts", "event_id"]), []
        for event_id, trigger, ts in held.itertuples(index=False, name=None):
            trigger = trigger if isinstance(trigger, str) else None
            now, status, reason = decide(now, trigger or "unknown", ts.timestamp(), cfg)
            out.append((key[0], event_id, trigger, status, reason, now[1]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["project", "event_id", "trigger", "status", "reason", "pending"])
                out = []
        state.update(now)
        yield pd.DataFrame(out, columns=["project", "event_id", "trigger", "status", "reason", "pending"])

    return events.groupBy("project").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, on_change: Callable[[DataFrame], None], checkpoint: str, seconds: float | None = None, pattern: str = "*"):
    """Run `on_change` on the files that are new or changed in a folder, a batch a trigger; ends at once without `seconds`.

    The trigger's interval gathers changes that come close together. The stream's checkpoint remembers what was seen, and
    a file counts once a batch by its latest content.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        newest = df.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"))
        if not newest.isEmpty():
            on_change(newest)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def changed(old: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new manifest of (path, content), and what differs from the old one; only that needs to be extracted again."""
    new = fingerprints(files)
    return new, manifest_diff(old, new)


def replay(events: Iterable[tuple[str, float]], config: AutoRun) -> list[tuple[str, str]]:
    """Decisions of (trigger, time) events of one project, without a stream."""
    state, out = (0, 0, None, None), []
    for trigger, now in events:
        state, status, reason = decide(state, trigger, now, config)
        out.append((status, reason))
    return out
