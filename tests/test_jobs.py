"""The jobs over growing input, after failures, and against one pass over everything."""

import json
import os
import subprocess
import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import catalog_feed, usage_rollup
from jobs.common import settings
from tessera.plans import index as index_plan
from tessera.plans import search as search_plan
from tessera.schema import QUERIES, normalized

ROW = "id string, name string, source string, text string, rev bigint, gone boolean"
FEED = catalog_feed.Feed(columns={"id": "id", "name": "name", "title": "name", "description": "text", "source": "source"}, revision="rev", deleted="gone", buckets=4, as_of="2026-01-01T00:00:00Z")
FIRST = [
    ("a", "alpha", "registry", "Reads mail. And writes it.", 1, False), ("b", "beta", "registry", "Draws maps of rivers.", 1, False),
    ("c", "gamma", "file", "Plays music in the evening.", 1, False), ("c", "gamma", "file", "Plays music in the evening.", 1, False),
    ("d", "delta", "file", None, 1, None), ("", "nobody", "file", "No id.", 1, False), (None, "none", "file", "No id either.", 1, False),
]
SECOND = [
    ("a2", "Alpha", "github", "Another words for mail.", 1, False),  # merges with a
    ("b", "rivers", "registry", "Draws maps of rivers and lakes.", 2, False),  # changes its identity
    ("c", "gamma", "file", "Plays music in the morning.", 0, False),  # an older version
    ("d", "delta", "file", None, 2, True), ("e", "epsilon", "file", "Counts stars at night.", 1, False),
]


def land(spark, rows, folder, name):
    """One more landed file, under a name of its own."""
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{folder}/in/{name}")


def state(spark, out):
    """Every point with its terms and its vector."""
    points, terms = (catalog_feed.table(spark, out, n) for n in ("points", "terms"))
    held = terms.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("term", F.round("weight", 9).alias("weight")))).alias("terms"))
    return sorted(map(str, points.join(held, "point_id", "left").select("mcp_id", "kind", "ordinal", "query", "source", "text", "terms", "vector").collect()))


def catalogue(spark, out):
    return {r["id"]: r for r in catalog_feed.table(spark, out, "catalog").collect()}


def test_feed_takes_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path)
    out, checkpoint = f"{folder}/index", f"{folder}/checkpoint"
    go = lambda: catalog_feed.run(spark, f"{folder}/in/*", out, checkpoint, FEED)
    land(spark, FIRST, folder, "1")
    assert go().read == len(FIRST)
    first = catalogue(spark, out)
    assert set(first) == {"a", "b", "c", "d"} and first["c"]["description"] == "Plays music in the evening."
    assert spark.read.parquet(f"{out}/rejected").count() == 2
    before = state(spark, out)
    again = go()
    assert (again.read, again.touched) == (0, 0) and state(spark, out) == before
    land(spark, SECOND, folder, "2")
    assert go().read == len(SECOND)
    second = catalogue(spark, out)
    assert set(second) == {"a", "b", "c", "e"}
    assert second["a"]["sources"] == ["registry", "github"] and second["a"]["description"] == "Reads mail. And writes it."
    assert second["b"]["name"] == "rivers" and second["c"]["description"] == "Plays music in the evening."
    assert {r["mcp_id"] for r in catalog_feed.table(spark, out, "points").collect()} == set(second)
    # the same as all files at once, and as one build without a feed
    catalog_feed.run(spark, f"{folder}/in/*", f"{folder}/whole", f"{folder}/other", FEED)
    assert state(spark, f"{folder}/whole") == state(spark, out)
    # a new checkpoint takes everything again, to the same result
    catalog_feed.run(spark, f"{folder}/in/*", out, f"{folder}/third", FEED)
    assert state(spark, out) == state(spark, f"{folder}/whole")


def test_feed_rewrites_touched_buckets_alone(spark, tmp_path):
    folder = str(tmp_path)
    out = f"{folder}/index"
    land(spark, [(str(i), f"name {i}", "file", f"text number {i}", 1, False) for i in range(40)], folder, "1")
    go = lambda: catalog_feed.run(spark, f"{folder}/in/*", out, f"{folder}/cp", FEED)
    go()
    batches = lambda: {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{out}/points").select("bucket", "batch").distinct().collect()}
    assert set(batches().values()) == {0} and len(batches()) == 4
    land(spark, [("7", "name 7", "file", "another text", 2, False)], folder, "2")
    go()
    assert sorted(batches().values()) == [0, 0, 0, 1]
    # the last row of a bucket goes
    land(spark, [(str(i), f"name {i}", "file", None, 3, True) for i in range(40)], folder, "3")
    go()
    assert not state(spark, out)


def test_feed_repeats_a_batch_that_was_cut_off(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    out = f"{folder}/index"
    land(spark, FIRST, folder, "1")
    go = lambda: catalog_feed.run(spark, f"{folder}/in/*", out, f"{folder}/cp", FEED)
    go()
    land(spark, SECOND, folder, "2")
    write = catalog_feed.replace_partitions

    def failing(df, path, *by):
        if path.endswith("/points"):
            raise OSError("the disk is gone")
        write(df, path, *by)

    monkeypatch.setattr(catalog_feed, "replace_partitions", failing)
    with pytest.raises(StreamingQueryException):
        go()
    monkeypatch.setattr(catalog_feed, "replace_partitions", write)
    assert go().read == len(SECOND)
    catalog_feed.run(spark, f"{folder}/in/*", f"{folder}/whole", f"{folder}/other", FEED)
    assert state(spark, out) == state(spark, f"{folder}/whole")
    assert spark.read.parquet(f"{out}/records").where("id = 'e'").count() == 1


def test_feed_shuffles_no_text_but_into_buckets(spark, tmp_path, monkeypatch):
    """Rows lie by bucket once they are records: what is made of them is written where it is made, and scratch goes.  Each table was dealt out anew, points twice."""
    folder, plans, write = str(tmp_path), {}, catalog_feed.replace_partitions
    held = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("tessera-identities-*/rows"))

    def looked_at(df, path, *by):
        plans[path.rpartition("/")[2]] = df._jdf.queryExecution().optimizedPlan().toString()
        write(df, path, *by)

    monkeypatch.setattr(catalog_feed, "replace_partitions", looked_at)
    before = held()
    land(spark, [(str(i), f"name {i}", "file", f"text number {i}", 1, False) for i in range(40)], folder, "1")
    catalog_feed.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/cp", FEED)
    assert not [n for n in catalog_feed.TABLES if "Repartition" in plans[n].replace("Repartition 1, false", "") or "Join" in plans[n]]
    assert held() == before
    rows = spark.read.parquet(f"{folder}/index/records")
    assert "Window" not in catalog_feed.latest(rows)._jdf.queryExecution().optimizedPlan().toString() and catalog_feed.latest(rows).count() == 40


def test_feed_puts_points_of_one_id_into_one_bucket(spark, tmp_path):
    """An id that two sources give to rows of several buckets has its points in the least of them."""
    folder = str(tmp_path)
    land(spark, [("x", f"name {i}", f"s{i}", f"text number {i}", 1, False) for i in range(8)] + [("y", "other", "file", "more", 1, False)], folder, "1")
    catalog_feed.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/cp", FEED)
    read = lambda n: spark.read.parquet(f"{folder}/index/{n}")
    rows = {r["bucket"] for r in read("catalog").where("id = 'x'").collect()}
    assert len(rows) > 1
    for name in ("points", "terms"):
        own = read("points").where("mcp_id = 'x'").select("point_id")
        assert {r["bucket"] for r in read(name).join(own, "point_id").select("bucket").distinct().collect()} == {min(rows)}


def test_searches_over_the_feed(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(str(i), f"name {i}", "file", f"{w} of the house number {i % 7}. Then more {w}.", 1, False) for i, w in enumerate("river stone light table water green seven paper cloud winter morning music".split() * 3)]
    land(spark, rows[:20], folder, "1")
    for part in (rows[:20], rows[20:]):
        if part is not rows[:20] and part[0] == rows[20]:
            land(spark, part, folder, "2")
        catalog_feed.run(spark, f"{folder}/in/*", f"{folder}/index", f"{folder}/cp", FEED)
    asked = spark.createDataFrame([(1, "river water", 5, 0.0, [], ""), (2, "music in the house", 7, 0.0, [], "file")], QUERIES)
    whole = normalized(spark.createDataFrame(rows, ROW).select("id", "name", F.col("name").alias("title"), F.col("text").alias("description"), "source", F.col("id").alias("pos")), "pos")
    found = lambda index: [(r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in search_plan.search(asked, index, FEED.config()).orderBy("qid", "rank").collect()]
    want = found(index_plan.build(whole, FEED.config(), FEED.as_of))
    assert len(want) == 12 and found(catalog_feed.load(spark, f"{folder}/index", FEED)) == want


DAY = datetime(2024, 3, 1)
RULES = usage_rollup.Rollup(time="ts", item="item", outcome="outcome", late_days=1, trailing_days=3, failing_share=0.5, failing_calls=2)


def calls(*rows):
    return [(DAY + timedelta(days=d, hours=3), item, outcome) for d, item, outcome in rows]


def events(spark, folder, name, rows):
    spark.createDataFrame(rows, "ts timestamp_ntz, item string, outcome string").coalesce(1).write.parquet(f"{folder}/events/{name}")


def tables(spark, out):
    return [sorted(map(str, spark.read.parquet(f"{out}/{n}").select("day", "mcp_id", "*").collect())) for n in ("daily", "standing")]


def test_rollup_over_growing_input(spark, tmp_path):
    folder = str(tmp_path)
    out = f"{folder}/out"
    go = lambda to=out, **x: usage_rollup.run(spark, f"{folder}/events/*", to, RULES, **x)
    events(spark, folder, "1", [*calls((0, "a", "success"), (0, "a", "tool_error"), (1, "b", "unreachable"), (1, "b", "odd"), (2, "a", "success"), (2, "a", "success")), (None, "a", "success"), (DAY, "", "success"), (DAY, None, "success")])
    assert go() == {"read": 9, "left out": 3, "daily": 3, "standing": 5}
    rows = {(r["day"], r["mcp_id"]): r for r in spark.read.parquet(f"{out}/standing").collect()}
    last = rows[date(2024, 3, 3), "a"]
    assert (last["calls"], last["successes"], last["tool_errors"], last["idle_days"], last["failing"]) == (4, 3, 1, 0, False)
    assert rows[date(2024, 3, 3), "b"]["failing"] and rows[date(2024, 3, 3), "b"]["idle_days"] == 1 and rows[date(2024, 3, 1), "a"]["usage_before"] == 0
    before = tables(spark, out)
    assert go()["read"] == 4 and tables(spark, out) == before  # the mark's day and the one before it alone
    events(spark, folder, "2", calls((1, "c", "success"), (4, "a", "success"), (3, "a", "unreachable")))
    assert go()["read"] == 7
    go(f"{folder}/whole")
    assert tables(spark, out) == tables(spark, f"{folder}/whole")
    events(spark, folder, "3", calls((0, "z", "success")))  # later than a run looks back
    go()
    assert tables(spark, out) == tables(spark, f"{folder}/whole")
    go(since=date(2024, 3, 1)), go(f"{folder}/new")
    assert tables(spark, out) == tables(spark, f"{folder}/new") != tables(spark, f"{folder}/whole")


def test_rollup_that_was_cut_off(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    out = f"{folder}/out"
    events(spark, folder, "1", calls((0, "a", "success"), (1, "b", "success")))
    usage_rollup.run(spark, f"{folder}/events/*", out, RULES)
    events(spark, folder, "2", calls((5, "a", "success"), (6, "b", "tool_error")))
    write = usage_rollup.replace_partitions

    def failing(df, path, *by):
        write(df.where("day < '2024-03-05'"), path, *by)
        if path.endswith("/standing"):
            raise OSError("the disk is gone")

    monkeypatch.setattr(usage_rollup, "replace_partitions", failing)
    with pytest.raises(OSError):
        usage_rollup.run(spark, f"{folder}/events/*", out, RULES)
    monkeypatch.setattr(usage_rollup, "replace_partitions", write)
    usage_rollup.run(spark, f"{folder}/events/*", out, RULES), usage_rollup.run(spark, f"{folder}/events/*", f"{folder}/whole", RULES)
    assert tables(spark, out) == tables(spark, f"{folder}/whole")
    events(spark, folder, "none", [])
    assert usage_rollup.run(spark, f"{folder}/events/none", f"{folder}/empty", RULES) == {"read": 0, "left out": 0, "daily": 0, "standing": 0}


def test_settings_files():
    feed, rules = settings(catalog_feed.Feed, None, "catalog_feed"), settings(usage_rollup.Rollup, None, "usage_rollup")
    assert feed.config().sparse == "tf" and rules.trailing_days == 7
    assert not [p for p in Path(catalog_feed.__file__).parent.glob("*.py") if "llm" in p.read_text().split()]


def test_command_lines(spark, tmp_path):
    """Each job by its command, with a settings file of its own."""
    folder = str(tmp_path)
    events(spark, folder, "1", calls((0, "a", "success"), (1, "b", "success")))
    land(spark, FIRST, folder, "1")
    (tmp_path / "rules.json").write_text(json.dumps({"time": "ts", "item": "item", "outcome": "outcome", "trailing_days": 2}))
    (tmp_path / "feed.json").write_text(json.dumps({"columns": {"id": "id", "name": "name", "description": "text"}, "buckets": 2}))
    root = Path(catalog_feed.__file__).parent.parent
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for words in (["usage_rollup.py", "--events", f"{folder}/events/*", "--out", f"{folder}/usage", "--config", f"{folder}/rules.json"], ["catalog_feed.py", "--landing", f"{folder}/in/*", "--out", f"{folder}/index", "--checkpoint", f"{folder}/cp", "--config", f"{folder}/feed.json"]):
        done = subprocess.run([sys.executable, str(root / "jobs" / words[0]), *words[1:], "--shared", f"{folder}/shared"], env=env, cwd=folder, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read " in done.stderr and "wrote " in done.stderr
    assert spark.read.parquet(f"{folder}/usage/daily").count() == 2
    assert set(catalogue(spark, f"{folder}/index")) == {"a", "b", "c", "d"}
