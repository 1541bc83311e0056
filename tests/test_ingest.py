"""Steps between the raw tables and the queries."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sentrilake.operators import graph, ordering
from sentrilake.plans import adapter, stream_queries

KINDS = ["click", "view", "error", "signup", "purchase"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Raw events of seven users, some of them at the same time."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=(i * 37) % 400 // 3), i % 7, KINDS[i * i % 5], 1.5, f'{{"k": {i * 13 % 100}}}')
            for i in range(900)]
    path = str(tmp_path_factory.mktemp("tables"))
    raw = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    raw.write.parquet(f"{path}/events.parquet")
    return path


def test_raw_rows_are_sorted_not_events(spark, tables, monkeypatch):
    """The same places as those of the events, without a shuffle of the wide rows."""
    want = sorted((r.event_id, r.ord) for r in ordering.deterministic_order(adapter.session_events(spark, tables)).collect())
    seen = []
    place = ordering.dense_position

    def noted(df, *rest):
        seen.append(df.columns)
        return place(df, *rest)

    for module in (ordering, adapter):
        monkeypatch.setattr(module, "dense_position", noted, raising=False)
    placed = adapter.ordered_events(spark, tables)
    assert seen and all("data" not in columns for columns in seen)
    assert sorted((r.event_id, r.ord) for r in placed.select("event_id", "ord").collect()) == want
    plain = adapter.session_events(spark, tables)
    assert placed.columns == [*plain.columns, "ord"]
    texts = [sorted(r[0] for r in df.select(F.to_json(F.struct(*plain.columns))).collect()) for df in (placed, plain)]
    assert texts[0] == texts[1] and len(texts[0]) == 900


def test_only_chains_of_wanted_events_are_sorted(spark, tables, monkeypatch):
    events = adapter.ordered_events(spark, tables)
    counted = []

    def noted(rows, *rest, **more):
        counted.append(rows.count())
        return ordering.adjacent_pairs(rows, *rest, **more)

    monkeypatch.setattr(graph, "adjacent_pairs", noted)
    wanted = events.where(F.col("ord") == 60).select("artifact_id", "event_id")
    got = sorted(map(tuple, graph.edges_into(events, wanted).collect()))
    assert sum(counted) < 900 / 2
    monkeypatch.undo()
    keys = {tuple(r) for r in wanted.collect()}
    assert got == sorted(tuple(r) for r in graph.build_edges(events).collect() if (r.artifact_id, r.dst) in keys) and got


def test_batches_of_the_watch_have_many_files(spark, tables, monkeypatch):
    """No task writes or reads a third of the feed alone."""
    paths = {}
    plain = stream_queries.shared_path
    monkeypatch.setattr(stream_queries, "shared_path", lambda s, name: paths.setdefault(name, plain(s, name)))
    reports = stream_queries._watch_batches(spark, tables).collect()
    assert {r.batch for r in reports} == {0, 1, 2}
    feed = [x for x in os.listdir(paths["feed"].removeprefix("file://")) if x.endswith(".txt")]
    assert len(feed) > 3
