"""Registered queries of the indexing and search plans, and their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import usage
from .plans import index as index_plan
from .plans import search as search_plan
from .plans.config import Config
from .queries import _FIRST, _KEYS, _USAGE, AS_OF, HASHES, TOP, _calls, _strings, _words, query, r6, read, tooled

# ---- the whole search in DuckDB: points and their encodings, both retrievals, fusion, collapse, reranking, blend

#: Texts of all points of the catalogue that ``tooled`` makes, with their cards.
_POINTS = rf"""
  base AS (SELECT doc_id, text, lang, n_chars, p_name, p_type, 'doc-' || doc_id AS title, {_FIRST} AS sentence,
      lower(trim(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS phrase,
      CASE doc_id % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'github' ELSE 'file' END AS source FROM documents LEFT JOIN part ON p_partkey = doc_id),
  carded AS (SELECT *, list_filter([CASE WHEN phrase <> '' THEN 'how do I ' || phrase END, CASE WHEN phrase <> '' THEN 'I need to ' || phrase END, CASE WHEN phrase <> '' THEN p_type END, sentence, title], lambda x: x IS NOT NULL AND x <> '') AS asked0,
      (SELECT {_KEYS} FROM (SELECT base.title || ' ' || base.text AS text)) AS synonyms FROM base),
  cards AS (SELECT *, list_filter(asked0, lambda x, i: list_position(asked0, x) = i) AS asked FROM carded),
  points AS (
    SELECT doc_id, 0 AS ordinal, 'server' AS kind, '' AS tool, concat_ws(chr(10), title, title, text, CASE WHEN phrase <> '' THEN 'Can be used to: ' || phrase END, CASE WHEN len(synonyms) > 0 THEN 'Related: ' || array_to_string(synonyms, ', ') END, 'Categories: ' || lang, CASE WHEN p_name IS NOT NULL THEN 'Tools: ' || p_name END) AS body FROM cards
    UNION ALL SELECT doc_id, 1, 'tool', p_name, concat_ws(chr(10), p_name, p_type, 'From MCP: ' || title) FROM cards WHERE p_name IS NOT NULL
    UNION ALL SELECT doc_id, unnest(range(0, len(asked))) + CASE WHEN p_name IS NULL THEN 1 ELSE 2 END, 'query', '', unnest(asked) FROM cards)"""

_ENCODED = f"""
  every AS (SELECT 'd' AS side, doc_id AS id, ordinal, unnest({_words('body')}) AS word FROM points
      UNION ALL SELECT 'q', qid, 0, unnest({_words('query')}) FROM asked_for),
  {HASHES},
  counted AS (SELECT side, id, ordinal, word, term, count(*) AS n FROM every JOIN hashed USING (word) GROUP BY ALL),
  sums AS (SELECT side, id, ordinal, term % 256 AS idx, sum(CASE WHEN term >= 2147483648 THEN -n ELSE n END)::DOUBLE AS v FROM counted GROUP BY ALL),
  dense AS (SELECT side, id, ordinal, idx, (v / sqrt(sum(v * v) OVER (PARTITION BY side, id, ordinal)))::FLOAT::DOUBLE AS v FROM sums WHERE v <> 0),
  norms AS (SELECT side, id, ordinal, sqrt(sum(v * v)) AS norm FROM dense GROUP BY ALL),
  terms AS (SELECT side, id, ordinal, term, 1 + ln(sum(n)) AS w FROM counted WHERE NOT list_contains({_strings(X.SPARSE_STOP)}, word) GROUP BY ALL),
  weights AS (SELECT side, id, ordinal, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id, ordinal)) AS w FROM terms)"""

_BM25 = """
  lengths AS (SELECT id, ordinal, sum(n) AS dl FROM counted WHERE side = 'd' AND NOT list_contains({stop}, word) GROUP BY ALL),
  stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lengths),
  tf AS (SELECT side, id, ordinal, term, sum(n) AS tf FROM counted WHERE NOT list_contains({stop}, word) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf WHERE side = 'd' GROUP BY term),
  weights AS (SELECT 'd' AS side, id, ordinal, term, tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM tf JOIN lengths USING (id, ordinal), stats WHERE side = 'd'
      UNION ALL SELECT 'q', id, 0, term, ln(1 + (n - df + 0.5) / (df + 0.5)) FROM tf JOIN df USING (term), stats WHERE side = 'q')""".format(stop=_strings(X.SPARSE_STOP))

_PASSES = "(a.source = '' OR a.source = p.source) AND (len(a.categories) = 0 OR list_contains(a.categories, p.lang))"


def _pool_sql(asked: str, hybrid: bool = True, bm25: bool = False, fitted: bool = True) -> str:
    """CTEs up to ``pool``: qid, doc_id, score, kind, tool, match_count, pos.  ``asked`` selects qid, query, top_k, min_score, source, categories."""
    encoded = _ENCODED.partition("  terms AS")[0] + _BM25.lstrip() if bm25 else _ENCODED
    return f"""
  asked_for AS ({asked}), {_POINTS}, {encoded},
  ask AS (SELECT *, greatest(CASE WHEN top_k > 0 THEN top_k ELSE 5 END, 30) AS pool FROM asked_for),
  dots AS (SELECT q.id AS qid, d.id AS doc_id, d.ordinal, sum(q.v * d.v) AS s FROM dense q JOIN dense d ON q.side = 'q' AND d.side = 'd' AND q.idx = d.idx GROUP BY ALL),
  cosines AS (SELECT a.qid, p.doc_id, p.ordinal, p.kind, p.tool, a.pool, coalesce(s / (nq.norm * nd.norm), 0) AS score
      FROM ask a JOIN (SELECT points.*, source, lang FROM points JOIN base USING (doc_id)) p ON {_PASSES}
      LEFT JOIN dots t ON t.qid = a.qid AND t.doc_id = p.doc_id AND t.ordinal = p.ordinal
      LEFT JOIN norms nq ON nq.side = 'q' AND nq.id = a.qid LEFT JOIN norms nd ON nd.side = 'd' AND nd.id = p.doc_id AND nd.ordinal = p.ordinal),
  by_dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id::VARCHAR, ordinal) - 1 AS pos FROM cosines),
  products AS (SELECT q.id AS qid, d.id AS doc_id, d.ordinal, sum(q.w * d.w) AS score FROM weights q JOIN weights d ON q.side = 'q' AND d.side = 'd' AND q.term = d.term GROUP BY ALL),
  by_sparse AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 9) DESC, s.doc_id::VARCHAR, s.ordinal) - 1 AS pos FROM products s JOIN cosines c USING (qid, doc_id, ordinal) WHERE {str(fitted).lower()}),
  hybrid AS (SELECT DISTINCT id AS qid FROM weights WHERE side = 'q' AND {str(hybrid).lower()}),
  lists AS (SELECT qid, doc_id, ordinal, pos FROM by_dense JOIN ask USING (qid) WHERE pos < 8 * ask.pool + 20 AND qid IN (FROM hybrid)
      UNION ALL SELECT qid, doc_id, ordinal, pos FROM by_sparse JOIN ask USING (qid) WHERE pos < 8 * ask.pool + 20 AND qid IN (FROM hybrid)),
  fused AS (SELECT qid, doc_id, ordinal, sum(1.0::DOUBLE / (2 + pos)) AS score FROM lists GROUP BY ALL
      UNION ALL SELECT qid, doc_id, ordinal, score FROM by_dense WHERE qid NOT IN (FROM hybrid)),
  surfaced AS (SELECT * FROM (SELECT qid, doc_id, ordinal, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id::VARCHAR, ordinal) - 1 AS pos FROM fused) JOIN (SELECT qid, pool FROM ask) USING (qid) WHERE pos < 4 * pool + 10),
  collapsed AS (SELECT qid, doc_id, arg_min(kind, s.pos) AS kind, arg_min(tool, s.pos) AS tool, max(score) AS score, count(*) AS match_count, any_value(pool) AS pool FROM surfaced s JOIN points USING (doc_id, ordinal) GROUP BY qid, doc_id),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id::VARCHAR) - 1 AS pos FROM collapsed) WHERE pos < pool)"""


_CANDIDATE = f"list_distinct({_words('body', X.RERANK_STOP)})"


def _found_sql(asked: str, hybrid: bool = True, bm25: bool = False, rerank: bool = True, used: bool = True, trust: bool = True) -> str:
    """CTEs up to ``found``: the hits that the search returns."""
    ranked = (
        f"""reranked AS (SELECT qid, doc_id, kind, tool, match_count, CASE WHEN len(qt) > 0 THEN share ELSE score END AS score,
          row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN len(qt) > 0 THEN round(share, 9) END DESC NULLS LAST, CASE WHEN len(qt) > 0 THEN round(score, 9) END DESC NULLS LAST, pos) - 1 AS pos
        FROM (SELECT p.*, qt, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct))::DOUBLE / len(qt) END AS share FROM pool p
          JOIN (SELECT qid, list_distinct({_words('query', X.RERANK_STOP)}) AS qt FROM asked_for) USING (qid)
          JOIN (SELECT doc_id, {_CANDIDATE} AS ct FROM (SELECT doc_id, concat_ws(chr(10), title, text, phrase, array_to_string(asked, ' '), array_to_string(synonyms, ' '), lang, p_name, p_type) AS body FROM cards)) USING (doc_id)))"""
        if rerank
        else "reranked AS (SELECT qid, doc_id, kind, tool, match_count, score, pos FROM pool)"
    )
    prior = "0.4::DOUBLE * (CASE WHEN n_chars <= 0 THEN 0 ELSE least(1.0::DOUBLE, log10(n_chars + 1) / 4) END) + 0.15::DOUBLE + 0.3::DOUBLE * ((text <> '')::INT + (p_name IS NOT NULL)::INT + 1) / 4" if trust else "0.0::DOUBLE"
    return f"""{_pool_sql(asked, hybrid, bm25)},
  {ranked}, {_USAGE},
  relevance AS (SELECT *, CASE WHEN max(score::FLOAT::DOUBLE) OVER w > min(score::FLOAT::DOUBLE) OVER w THEN (score::FLOAT::DOUBLE - min(score::FLOAT::DOUBLE) OVER w) / (max(score::FLOAT::DOUBLE) OVER w - min(score::FLOAT::DOUBLE) OVER w) ELSE 1 - pos::DOUBLE / count(*) OVER w END AS rel FROM reranked WINDOW w AS (PARTITION BY qid)),
  blended AS (SELECT qid, doc_id, kind, tool, match_count, pos, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score))::FLOAT AS confidence,
      0.7::DOUBLE * rel + 0.05::DOUBLE * (CASE WHEN match_count <= 1 THEN 0 ELSE 1 - 1.0::DOUBLE / match_count END) + 0.15::DOUBLE * ({prior}) + 0.1::DOUBLE * {'coalesce(usage, 0)' if used else '0'} AS final
    FROM relevance JOIN cards USING (doc_id) LEFT JOIN used ON user_id = doc_id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, pos) AS place FROM blended),
  found AS (SELECT placed.*, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank, title, categories_of AS categories, lang FROM placed JOIN (SELECT doc_id, title, lang, [lang] AS categories_of FROM cards) USING (doc_id)
      JOIN ask USING (qid) WHERE min_score <= 0 OR confidence::DOUBLE >= min_score QUALIFY rank <= CASE WHEN top_k > 0 THEN top_k ELSE 5 END)"""


_HITS = "SELECT qid, doc_id::VARCHAR AS id, rank::BIGINT AS rank, round(final::FLOAT::DOUBLE, 5) AS score, round(confidence::DOUBLE, 6) AS confidence, kind AS match_kind, tool AS matched_tool, match_count::BIGINT AS match_count FROM found"


def built(spark, sf_dir: str, config: Config = Config(), steps: index_plan.Steps = index_plan.Steps()) -> index_plan.Index:
    """The index of the whole catalogue with tools, cards and trust, to be searched alone."""
    return index_plan.build(tooled(spark, sf_dir).drop("doc_id"), config, AS_OF, steps, texts=False)


def _used(spark, sf_dir: str) -> DataFrame:
    return usage.with_scores(usage.tally(_calls(read(spark, sf_dir, "events"))))


def _asked(spark, sf_dir: str, **columns) -> DataFrame:
    given = {"query": F.col("text"), "top_k": F.lit(TOP), "min_score": F.lit(0.0), "source": F.lit(""), "categories": F.array().cast("array<string>")} | columns
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), *[c.alias(n) for n, c in given.items()])


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.round(F.col("score").cast("double"), 5).alias("score"), r6(F.col("confidence").cast("double")).alias("confidence"), "match_kind", "matched_tool", F.col("match_count").cast("bigint").alias("match_count"))


_PLAIN = f"SELECT item_id AS qid, text AS query, {TOP} AS top_k, 0.0 AS min_score, '' AS source, []::VARCHAR[] AS categories FROM benchmark"


@query(f"WITH {_found_sql(_PLAIN)} {_HITS}")
def search_end_to_end(spark, sf_dir):
    """Every benchmark text as a query over the whole catalogue, with cards, tools, trust and usage."""
    return _hits(search_plan.search(_asked(spark, sf_dir), built(spark, sf_dir), usage=_used(spark, sf_dir)))


_MIXED = f"""SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'the and of' ELSE text END AS query, (item_id % 4 - 1)::INT * 12 AS top_k, CASE WHEN item_id % 3 = 0 THEN 0.6 ELSE 0.0 END AS min_score,
  CASE item_id % 4 WHEN 1 THEN 'github' WHEN 2 THEN 'nowhere' ELSE '' END AS source, CASE WHEN item_id % 2 = 0 THEN []::VARCHAR[] ELSE ['en', 'fr'] END AS categories FROM benchmark"""


@query(f"WITH {_found_sql(_MIXED)} {_HITS}")
def search_filtered(spark, sf_dir):
    """Each query with its own filters, size and cut-off; some have stop words alone and go by cosine."""
    return _hits(search_plan.search(_mixed(spark, sf_dir), built(spark, sf_dir), usage=_used(spark, sf_dir)))


def _mixed(spark, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return _asked(
        spark, sf_dir, query=F.when(i % 5 == 0, "the and of").otherwise(F.col("text")), top_k=((i % 4 - 1) * 12).cast("int"), min_score=F.when(i % 3 == 0, 0.6).otherwise(0.0),
        source=F.when(i % 4 == 1, "github").when(i % 4 == 2, "nowhere").otherwise(""), categories=F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en"), F.lit("fr"))),
    )


@query(f"WITH {_found_sql(_PLAIN, hybrid=False, rerank=False, used=False, trust=False)} {_HITS}")
def search_dense_only(spark, sf_dir):
    """Cosine alone, without reranking, trust or a recorder of usage."""
    config = Config(hybrid=False, reranker="none", trust="none")
    return _hits(search_plan.search(_asked(spark, sf_dir), built(spark, sf_dir, config), config))


@query(f"WITH {_found_sql(_PLAIN, bm25=True)} {_HITS}")
def search_bm25(spark, sf_dir):
    config = Config(sparse="bm25")
    return _hits(search_plan.search(_asked(spark, sf_dir), built(spark, sf_dir, config), config, _used(spark, sf_dir)))


@query(f"WITH {_found_sql(_MIXED)} {_HITS}")
def search_by_index(spark, sf_dir):
    """The filtered searches again, by inverted lists (all of them visited, so that nothing is missed) and blocks of postings."""
    config = Config(retrieval="index")
    return _hits(search_plan.search(_mixed(spark, sf_dir), built(spark, sf_dir, config).with_retrieval(share=1.0), config, _used(spark, sf_dir)))


_POOL = "SELECT qid, doc_id::VARCHAR AS id, pos::BIGINT AS pos, round(score, 6) AS score, kind AS match_kind, tool AS matched_tool, match_count::BIGINT AS match_count FROM pool"


@query(f"WITH {_pool_sql(_PLAIN)} {_POOL}")
def dense_sparse_fusion(spark, sf_dir):
    """The pool of each query: both retrievals fused by rank and collapsed to the parent."""
    return _pooled(search_plan.candidates(_asked(spark, sf_dir), built(spark, sf_dir)))


@query(f"WITH {_pool_sql(_PLAIN, fitted=False)} {_POOL}")
def fusion_without_statistics(spark, sf_dir):
    """Where statistics cannot be computed the index has its dense side alone."""

    def failing(counts: DataFrame) -> DataFrame:
        raise OSError("no place for statistics")

    return _pooled(search_plan.candidates(_asked(spark, sf_dir), built(spark, sf_dir, steps=index_plan.Steps(fit=failing))))


def _pooled(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("mcp_id").alias("id"), F.col("pos").cast("bigint").alias("pos"), r6(F.col("score")).alias("score"), "match_kind", "matched_tool", F.col("match_count").cast("bigint").alias("match_count"))
