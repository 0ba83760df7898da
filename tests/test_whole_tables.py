"""Queries that read streams of files take up every file, and no query reads a part of its tables by id."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import topolake.plans
from tests.test_queries import SF
from topolake.plans import queries_files


def test_watch_takes_up_every_file(spark, monkeypatch):
    seen, watch = [], queries_files.auto_run.watch
    monkeypatch.setattr(queries_files.auto_run, "watch", lambda s, folder, *a, **k: (seen.append(folder), watch(s, folder, *a, **k))[1])
    assert queries_files.w1(spark, SF).first()["files"] == 5
    lines = queries_files.source_files(spark, SF).select(F.sum(F.size(F.split("content", "\n")))).first()[0]
    assert spark.read.text(seen[0]).count() == lines and queries_files.source_files(spark, SF).count() > 50


def test_no_query_takes_low_ids_only():
    for path in Path(topolake.plans.__file__).parent.glob("queries_*.py"):
        assert not re.search(r"(p_partkey|event_id|doc_id|page_id|ord) < \d\d", path.read_text()), path
