"""The jobs as registered queries: each run twice into one new folder, and its whole output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobs import catalog_feed, usage_rollup
from jobs.common import settings
from tessera.functions import text as X
from tessera.queries import _FIRST, _KEYS, HASHES, _strings, _words, query, r6
from tessera.scratch import scratch_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other call has; its files stay."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(rf"""WITH base AS (SELECT doc_id, text, lang, 'doc-' || doc_id AS title, {_FIRST} AS sentence, 'doc ' || doc_id AS phrase, CASE doc_id % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'github' ELSE 'file' END AS source FROM documents),
  carded AS (SELECT *, list_filter([sentence, title], lambda x: x IS NOT NULL AND x <> '') AS asked0, (SELECT {_KEYS} FROM (SELECT base.title || ' ' || base.text AS text)) AS synonyms FROM base),
  cards AS (SELECT *, list_filter(asked0, lambda x, i: list_position(asked0, x) = i) AS asked FROM carded),
  points AS (
    SELECT doc_id, 0 AS ordinal, 'server' AS kind, '' AS query, concat_ws(chr(10), title, title, text, CASE WHEN len(synonyms) > 0 THEN 'Related: ' || array_to_string(synonyms, ', ') END, 'Categories: ' || lang) AS body FROM cards
    UNION ALL SELECT doc_id, unnest(range(0, len(asked))) + 1, 'query', unnest(asked), unnest(asked) FROM cards),
  every AS (SELECT doc_id, ordinal, unnest({_words('body', X.SPARSE_STOP)}) AS word FROM points), {HASHES},
  terms AS (SELECT doc_id, ordinal, term, 1 + ln(count(*)) AS w FROM every JOIN hashed USING (word) GROUP BY ALL),
  weighed AS (SELECT doc_id, ordinal, count(*) AS n_terms, sum(w) / sqrt(sum(w * w)) AS weight FROM terms GROUP BY ALL)
SELECT doc_id::VARCHAR AS mcp_id, source, kind, ordinal::BIGINT AS ordinal, query, sha256(body) AS text_sha256, coalesce(n_terms, 0)::BIGINT AS n_terms, round(coalesce(weight, 0), 6) AS weight
FROM points JOIN base USING (doc_id) LEFT JOIN weighed USING (doc_id, ordinal)""")
def job1_catalog_feed(spark, sf_dir):
    """All documents as landed records: every point of the index with its text and its terms."""
    out, feed = new_folder(spark, "job1"), settings(catalog_feed.Feed, None, "catalog_feed")
    for _ in range(2):
        catalog_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{out}/index", f"{out}/checkpoint", feed)
    points, terms = (catalog_feed.table(spark, f"{out}/index", n) for n in ("points", "terms"))
    weighed = terms.groupBy("point_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("weight"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return points.join(weighed, "point_id", "left").select("mcp_id", "source", "kind", F.col("ordinal").cast("bigint").alias("ordinal"), "query", F.sha2("text", 256).alias("text_sha256"), zero("n_terms").alias("n_terms"), r6(zero("weight")).alias("weight"))


@query("""WITH daily AS (SELECT ts::DATE AS day, user_id::VARCHAR AS mcp_id, count(*) AS calls, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS successes, count(*) FILTER (event_type = 'signup') AS tool_errors
    FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
  days AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM daily),
  sums AS (SELECT t.day, mcp_id, sum(calls) AS calls, sum(successes) AS successes, sum(tool_errors) AS tool_errors, coalesce(sum(calls) FILTER (d.day < t.day), 0) AS b_calls,
    coalesce(sum(successes) FILTER (d.day < t.day), 0) AS b_successes, coalesce(sum(tool_errors) FILTER (d.day < t.day), 0) AS b_tool_errors, max(d.day) AS last_call
    FROM days t JOIN daily d ON d.day BETWEEN t.day - 6 AND t.day GROUP BY ALL)
SELECT s.day::VARCHAR AS day, s.mcp_id, coalesce(d.calls, 0)::BIGINT AS calls_of_day, s.calls::BIGINT AS calls, s.successes::BIGINT AS successes, s.tool_errors::BIGINT AS tool_errors,
  round((s.successes + 0.5::DOUBLE * s.tool_errors + 1) / (s.calls + 2) * least(1.0::DOUBLE, log10(s.calls + 1) / 2), 6) AS usage,
  round(CASE WHEN b_calls = 0 THEN 0 ELSE (b_successes + 0.5::DOUBLE * b_tool_errors + 1) / (b_calls + 2) * least(1.0::DOUBLE, log10(b_calls + 1) / 2) END, 6) AS usage_before,
  (s.day - last_call)::INTEGER AS idle_days, s.calls >= 3 AND s.calls - s.successes > 0.4::DOUBLE * s.calls AS failing
FROM sums s LEFT JOIN daily d USING (day, mcp_id)""")
def job2_usage_rollup(spark, sf_dir):
    """All events as calls: how each item stands on each day, with its calls of that day."""
    out, rules = new_folder(spark, "job2"), settings(usage_rollup.Rollup, None, "usage_rollup")
    for _ in range(2):
        usage_rollup.run(spark, f"{sf_dir}/events.parquet", out, rules)
    daily = spark.read.parquet(f"{out}/daily").select("day", "mcp_id", F.col("calls").alias("calls_of_day"))
    found = spark.read.parquet(f"{out}/standing").join(daily, ["day", "mcp_id"], "left")
    return found.select(F.col("day").cast("string").alias("day"), "mcp_id", F.coalesce("calls_of_day", F.lit(0)).alias("calls_of_day"), "calls", "successes", "tool_errors", r6(F.col("usage")).alias("usage"), r6(F.col("usage_before")).alias("usage_before"), "idle_days", "failing")
