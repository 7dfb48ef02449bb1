"""Inverted lists against exact search, and blocks of postings against the plain join."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, retrieve
from tessera.operators.dense_index import DenseIndex
from tessera.operators.sparse_index import SparseIndex
from tessera.plans import index as index_plan
from tessera.plans.config import Config

POINT = "point_id long, source string, categories array<string>, vector array<float>"
QUERY = "qid long, qvec array<float>, source string, categories array<string>"


def clustered(n, seed=1, groups=60, dim=24):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(size=(groups, dim))
    return centers[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))


def frame(spark, x, schema, **columns):
    rows = [(i, *(c[i] for c in columns.values()), v.tolist()) for i, v in enumerate(x)] if "vector" in schema.split("categories")[1] else [(i, v.tolist(), *(c[i] for c in columns.values())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, schema)


def points_of(spark, x):
    n = len(x)
    return frame(spark, x, POINT, source=[("rare" if i % 200 == 3 else f"s{i % 3}") for i in range(n)], categories=[[f"c{i % 4}", f"d{i % 7}"] if i % 5 else [] for i in range(n)]).repartition(4)


def queries_of(spark, x, source="", categories=()):
    return frame(spark, x, QUERY, source=[source] * len(x), categories=[list(categories)] * len(x))


def hits(found):
    out = {}
    for r in found.orderBy("qid", "pos").collect():
        out.setdefault(r["qid"], []).append((r["point_id"], round(r["score"], 6)))
    return out


def test_lists_find_the_nearest_and_visit_less_as_the_table_grows(spark, tmp_path):
    visited = {}
    for n in (1_500, 12_000):
        points, asked = points_of(spark, clustered(n)), queries_of(spark, clustered(60, seed=7))
        index, held_out = DenseIndex.build(points).tune(asked, 10, 0.95)
        assert held_out >= 0.9 and 30 < len(index.centroids) <= 2 * n**0.5 + 1 and index.sizes.sum() == n
        right, got = hits(retrieve.dense_candidates(asked, points, 10)), hits(index.search(asked, 10))
        found = sum(len(set(right[q]) & set(got[q])) for q in right)
        assert found >= 0.92 * 600 and all(len(v) == 10 for v in got.values())
        visited[n] = index.probes(asked, 10).agg(F.avg("visited")).first()[0] / n
    assert visited[12_000] < 0.6 * visited[1_500] < 0.2
    index.save(f"{tmp_path}/dense")
    again = DenseIndex.load(spark, f"{tmp_path}/dense")
    assert hits(again.search(asked, 10)) == got and again.share == index.share


def test_lists_with_filters(spark):
    points = points_of(spark, clustered(3_000))
    index = DenseIndex.build(points)
    for source, categories in (("s1", ()), ("rare", ()), ("", ("c1",)), ("s2", ("d3", "c2")), ("nowhere", ()), ("rare", ("c3",))):
        asked = queries_of(spark, clustered(25, seed=3), source, categories)
        right, got = hits(retrieve.dense_candidates(asked, points, 10)), hits(index.search(asked, 10))
        # whole results: as many as there are, however few lists hold them
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in right.items()}
        passing = [p for p in points.select("point_id", "source", "categories").collect() if source in ("", p["source"]) and (not categories or set(categories) & set(p["categories"]))]
        assert {p for v in got.values() for p, _ in v} <= {p["point_id"] for p in passing}
        if passing:
            assert sum(len(set(right[q]) & set(got[q])) for q in right) >= 0.9 * sum(map(len, right.values()))
        if len(passing) < 80:  # looked at all
            assert got == right


def test_lists_of_odd_points(spark, monkeypatch):
    x = clustered(300)
    x[:100] = x[0]  # a third of all rows are the same
    x[100:104] = 0
    points = points_of(spark, x)
    index = DenseIndex.build(points)
    asked = queries_of(spark, np.vstack([x[0], np.zeros(24), x[200], x[200]]))
    full = index.search(asked, 12)
    assert {q: len(v) for q, v in hits(full).items()} == {0: 12, 1: 12, 2: 12, 3: 12}
    right = hits(retrieve.dense_candidates(asked, points, 12))
    assert hits(full)[0] == right[0] and hits(full)[1] == right[1]
    monkeypatch.setattr(retrieve, "BLOCK", 2)
    assert hits(retrieve.in_blocks(asked, ["qid", "qvec", "source", "categories"], lambda rows: spark.createDataFrame([(r["qid"], 1, 0.5) for r in rows], "qid long, point_id long, score double"), lambda f: f.withColumn("pos", F.lit(0)), None, 2)) == {q: [(1, 0.5)] for q in range(4)}
    none = points.limit(0)
    assert DenseIndex.build(none).search(asked, 5).count() == 0 and index.search(asked.limit(0), 5).count() == 0


@pytest.fixture(scope="module")
def weighted(spark):
    """Weights of points whose terms are as uneven as words: term 0 is in nearly all."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(1_200):
        for t in sorted(set(np.minimum(rng.zipf(1.3, 25) - 1, 5_000).tolist())):
            rows.append((p, int(t) + 4_000_000_000 * (t % 2), float(np.round(rng.uniform(0.05, 1) * (0.2 if t < 5 else 1), 2))))
    asked = [(q, r[1], 1.0 + 0.1 * (q % 3)) for q in range(40) for r in rows if r[0] == q * 7]
    return spark.createDataFrame(rows, "point_id long, term long, weight double"), spark.createDataFrame(asked, "qid long, term long, weight double")


@pytest.mark.parametrize("limit,part,size", [(5, 1 << 16, 2_000), (1, 100, 2_000), (30, 100, 7), (2_000, 1 << 16, 2_000)])
def test_blocks_equal_the_join(spark, weighted, limit, part, size):
    weights, asked = weighted
    plain = retrieve.top(retrieve.sparse_scores(asked, weights, "point_id"), "qid", F.col("score"), limit, ["point_id"])
    index = SparseIndex.build(weights, part=part)
    assert index.postings.agg(F.max("part")).first()[0] == (0 if part > 1_200 else -(-weights.where("term = 0").count() // 100) - 1)
    assert hits(index.search(asked, limit, size=size)) == hits(plain)


def test_blocks_join_fewer_rows(spark, weighted):
    weights, asked = weighted
    index = SparseIndex.build(weights)
    bounded = index.bounded(asked)
    found, floor = index.candidates(bounded, 5)
    every = weights.join(asked, "term").select("qid", "point_id")
    n = found.count()
    assert n < 0.6 * every.distinct().count() and n < 0.25 * every.count() and floor.count() == 40


def test_blocks_with_a_filter(spark, weighted, tmp_path):
    weights, asked = weighted
    SparseIndex.build(weights).save(f"{tmp_path}/sparse")
    index = SparseIndex.load(spark, f"{tmp_path}/sparse")
    keep = lambda rows: rows.where("(point_id + qid) % 40 = 1")
    plain = retrieve.top(keep(retrieve.sparse_scores(asked, weights, "point_id")), "qid", F.col("score"), 8, ["point_id"])
    assert hits(index.search(asked, 8, keep)) == hits(plain)
    unknown = spark.createDataFrame([(1, 77_777, 1.0)], "qid long, term long, weight double")
    assert index.search(unknown, 5).count() == index.search(asked.limit(0), 5).count() == 0
    assert SparseIndex.build(weights.limit(0)).search(asked, 5).count() == 0


@pytest.mark.parametrize("limit", [3, 400])
def test_blocks_filter_rows_and_shuffle_no_pairs_beyond_the_points(spark, weighted, monkeypatch, limit):
    """Filters hold in rows of points; where the blocks left hold more postings than there are points, the rows are scored where they lie."""
    weights, asked = weighted
    rows = encode.gathered(weights, "point_id").withColumns({"source": F.concat(F.lit("s"), (F.col("point_id") % 3).cast("string")), "categories": F.array(F.concat(F.lit("c"), (F.col("point_id") % 4).cast("string")))})
    wanted = F.when(F.col("qid") % 4 == 0, "nowhere").when(F.col("qid") % 4 == 1, "s1").otherwise("")
    filters = asked.select("qid").distinct().withColumns({"source": wanted, "categories": F.when(F.col("qid") % 3 == 0, F.array(F.lit("c1"), F.lit("c2"))).otherwise(F.array().cast("array<string>"))})
    plain = retrieve.sparse_candidates(asked, rows, limit, filters=filters)
    index, pairs = SparseIndex.build_rows(rows), []
    scores = SparseIndex.scores
    monkeypatch.setattr(SparseIndex, "scores", lambda self, found, *a: (pairs.append(found.count()), scores(self, found, *a))[1])
    found = index.search(asked, limit, filters=filters)
    assert hits(found) == hits(plain) and {"source", "categories"} <= set(found.columns)
    assert limit < 400 or len(pairs) == 1  # the first candidates alone
    open_ = asked.where("qid % 4 <> 0")
    assert hits(index.search(open_, 3, filters=filters)) == hits(retrieve.sparse_candidates(open_, rows, 3, filters=filters))


def test_saved_index_keeps_its_lists(spark, tmp_path):
    from tessera.schema import normalized

    rows = spark.createDataFrame([(str(i), f"name {i}", f"a text about {w} and {i % 5}") for i, w in enumerate("river stone light table water green seven".split() * 6)], "id string, name string, description string")
    made = index_plan.build(normalized(rows.withColumn("pos", F.col("id")), "pos"), Config(retrieval="index")).with_retrieval(share=0.5)
    made.save(f"{tmp_path}/index")
    again = index_plan.Index.load(spark, f"{tmp_path}/index")
    assert again.lists.share == 0.5 and again.blocks.postings.count() == made.blocks.postings.count()


def test_index_has_a_row_of_terms_for_each_point(spark):
    """Searches read one row for each point, and what the build stored on its way is gone."""
    from tessera.schema import normalized
    from tessera.scratch import hadoop_path, scratch_root

    rows = spark.createDataFrame([(str(i), f"name {i}", f"a text about stones and {i % 5}") for i in range(20)], "id string, name string, description string")
    where, system = hadoop_path(spark, scratch_root(spark))
    held = lambda tag: {str(f.getPath()) for f in system.globStatus(hadoop_path(spark, f"{where}/tessera-{tag}-*/rows")[0])}
    before = held("bags") | held("points")
    made = index_plan.build(normalized(rows.withColumn("pos", F.col("id")), "pos"))
    assert made.terms.columns == ["point_id", "ts", "ws"] and made.terms.count() == made.points.count()
    assert held("bags") | held("points") == before


def _stored(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files)


def test_a_build_stores_each_text_twice_at_most(spark, tmp_path):
    """Rows and points, with terms and vectors; identities, cards and vectors made three more of a text and shuffled it as often."""
    from tessera.schema import normalized

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.substring(F.sha2(F.concat_ws("-", "id", i.cast("string")), 256), 1, 12)), " ")
    rows = spark.range(1_500).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("Some words. "), words).alias("description"), F.lpad(F.col("id").cast("string"), 9, "0").alias("pos"))
    rows.write.option("compression", "zstd").parquet(f"{tmp_path}/in")
    size = sum(f.stat().st_size for f in tmp_path.glob("in/*.parquet"))
    before = _stored(spark)
    made = index_plan.build(normalized(spark.read.parquet(f"{tmp_path}/in"), "pos"))
    assert made.points.count() == 1_500 * 2 and _stored(spark) - before < 4.5 * size, (_stored(spark) - before) / size
    plan = made.scored()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_memory_of_a_scan_does_not_grow_with_the_rows_of_a_batch():
    """A batch of four times the rows takes no more at once, and gives the best rows of all."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    shared = SimpleNamespace(value=([7], None, np.arange(3), np.ones(3, np.int64), np.zeros(3, np.int64), np.array([1.0, 2.0, 4.0])))
    peaks = []
    for n in (5_000, 20_000):
        terms, weights = np.tile(np.arange(200), n), np.random.default_rng(n).random(200 * n)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 200), pa.array(v)) for v in (terms, weights)]
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *lists], names=["doc_id", "ts", "ws"])
        want = (weights.reshape(n, 200)[:, :3] * [1.0, 2.0, 4.0]).sum(axis=1)
        tracemalloc.start()
        found = pa.Table.from_batches(list(retrieve._sharing(shared, 5, ["doc_id"], ["doc_id"])(iter([batch]))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found.column("doc_id").to_pylist() == np.argsort(-want)[:5].tolist()
    assert peaks[1] < 1.3 * peaks[0], peaks


def test_an_index_to_search_stores_each_text_once(spark, tmp_path):
    """Rows alone hold texts: a search reads terms and vectors of points, and the same rows are found; to be saved an index has the texts of its points."""
    from tessera.plans import search as search_plan
    from tessera.schema import normalized

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50)).cast("string"))), " ")
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("Some words. "), words).alias("description"), F.lpad(F.col("id").cast("string"), 9, "0").alias("pos"))
    rows.write.option("compression", "zstd").parquet(f"{tmp_path}/in")
    given, root, size = normalized(spark.read.parquet(f"{tmp_path}/in"), "pos"), _stored(spark), []
    made = []
    for texts in (True, False):
        made.append(index_plan.build(given, texts=texts))
        size.append(_stored(spark) - root)
        root = _stored(spark)
    assert size[1] < size[0] * 0.8, size
    asked = spark.createDataFrame([(1, "words w1 w2 w3", 5, 0.0, "", []), (2, "the and of", 3, 0.0, "", [])], "qid long, query string, top_k int, min_score double, source string, categories array<string>")
    want, got = (sorted(map(str, search_plan.search(asked, m).collect())) for m in made)
    assert got == want and len(got) == 8
    with pytest.raises(ValueError, match="texts"):
        made[1].save(f"{tmp_path}/index")


def test_a_search_encodes_its_queries_once(spark):
    """What joins the queries reads them as stored: each join made their vectors and terms anew, in one plan that the driver held."""
    from tessera.plans import search as search_plan
    from tessera.schema import normalized

    rows = spark.createDataFrame([(str(i), f"name {i}", f"a text about stones and {i % 5}") for i in range(20)], "id string, name string, description string")
    asked = spark.createDataFrame([(1, "stones 3", 5, 0.0, "", []), (2, "the and of", 3, 0.0, "", [])], "qid long, query string, top_k int, min_score double, source string, categories array<string>")
    found = search_plan.candidates(asked, index_plan.build(normalized(rows.withColumn("pos", F.col("id")), "pos")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the points that are scored
    assert {r["qid"] for r in found.collect()} == {1, 2}


def test_a_search_makes_cards_of_its_hits_alone(spark):
    """The rows that were found are taken out first, and then described as the catalogue describes all."""
    from tessera.plans import search as search_plan
    from tessera.schema import normalized

    rows = spark.createDataFrame([(str(i), f"name {i}", f"a text about stones and {i % 5}") for i in range(20)], "id string, name string, description string")
    asked = spark.createDataFrame([(1, "stones 3", 5, 0.0, "", [])], "qid long, query string, top_k int, min_score double, source string, categories array<string>")
    made = index_plan.build(normalized(rows.withColumn("pos", F.col("id")), "pos"), texts=False)
    found = search_plan.search(asked, made)
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")
    assert "heuristic" in above and "heuristic" not in below
    want = {r["id"]: (r["enrichment"], r["trust"]) for r in made.catalog.collect()}
    got = found.collect()
    assert len(got) == 5 and all(want[r["id"]] == (r["enrichment"], r["trust"]) for r in got)


def test_a_failure_of_the_statistics_is_no_result(spark, monkeypatch):
    """An index without its sparse side is made only where a step for it was handed in and failed; else the build fails."""
    from tessera.schema import normalized

    def failing(*_):
        raise OSError("no place")

    rows = normalized(spark.createDataFrame([("1", "name", "stones")], "id string, name string, description string").withColumn("pos", F.col("id")), "pos")
    with pytest.warns(UserWarning, match="no sparse index"):
        assert index_plan.build(rows, steps=index_plan.Steps(fit=failing)).terms.count() == 0
    monkeypatch.setattr(encode, "stats_of", failing)
    with pytest.raises(OSError, match="no place"):
        index_plan.build(rows)


def test_points_that_share_an_id(spark):
    """Of points with one id the last counts as a point, and every text counts for the statistics; other rows are not touched."""
    from tessera.schema import normalized

    tools = lambda *names: [{"name": n, "description": d} for n, d in names]
    rows = [("a", "first", "alpha one", tools(("x", "old words"), ("x", "new words"))), ("a", "second", "alpha two", []), ("b", "third", "beta", tools(("x", "own words")))]
    made = index_plan.build(normalized(spark.createDataFrame(rows, "id string, name string, description string, tools array<struct<name:string,description:string>>").withColumn("pos", F.col("name")), "pos"), Config(enricher="none"))
    got = sorted((r["mcp_id"], r["kind"], r["ordinal"]) for r in made.points.collect())
    assert got == [("a", "server", 0), ("a", "tool", 2), ("b", "server", 0), ("b", "tool", 1)]
    assert made.points.where("mcp_id = 'a' AND kind = 'tool'").first()["text"].startswith("x\nnew words")
    assert made.stats.first()["n"] == 6 and made.terms.count() == 4


def test_several_blocks_are_tasks_of_their_own(spark, monkeypatch):
    """Parts of one partition each were one partition together, so all blocks were searched by one task."""
    points, asked = points_of(spark, clustered(800)).repartition(16), queries_of(spark, clustered(60, seed=7))
    right, tasks, real = hits(retrieve.dense_candidates(asked, points, 10)), [], retrieve.top
    monkeypatch.setattr(retrieve, "ROWS", 200)  # blocks of 20 queries
    monkeypatch.setattr(retrieve, "top", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or real(rows, *a))
    assert hits(retrieve.dense_candidates(asked, points, 10)) == right and sum(tasks) >= 3


def test_what_several_blocks_shuffle_does_not_grow_with_the_partitions(spark, monkeypatch):
    """Each query's best rows are shuffled once; they came from every partition of the points for every block."""
    points, asked = points_of(spark, clustered(800)).repartition(16), queries_of(spark, clustered(60, seed=7))
    right, scanned, real = hits(retrieve.dense_candidates(asked, points, 10)), [], retrieve.top
    monkeypatch.setattr(retrieve, "ROWS", 200)  # blocks of 20 queries
    monkeypatch.setattr(retrieve, "top", lambda rows, *a: scanned.append(rows.count()) or real(rows, *a))
    assert hits(retrieve.dense_candidates(asked, points, 10)) == right and sum(scanned) == 600
