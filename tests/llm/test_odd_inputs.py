"""Every operator on one awkward table: clashing names, nulls, blanks, repeated rows, a very long text; and on none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, langid, lexicon, neardup, packing, pseudo, quality, secrets, separators

WORDS = "the of and a to in is was for on with as by at from that it an be this river house stone light table water green seven paper cloud winter morning".split()
#: Names that operators use inside or add.
CLASHES = ["spans", "score", "lang_pred", "n_words", "_t", "_row", "start", "length", "ids", "key", "node", "v", "rep", "est", "kept", "x0", "word", "_key", "_hash", "decoded", "c0", "_r", "qid"]
LONG = 120_000


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, prose(int(rng.integers(30, 80))), "en" if i % 2 else "de", f"s{i % 2}") for i in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \t\n", None, "s1"), (203, "...", "de", "s1"), rows[4], rows[4], (None, rows[5][1], "en", "s1"), (None, prose(50), None, None), (None, None, None, None)]
    rows += [(300, prose(LONG), "en", "s0")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES]).repartition(3).cache()


def own(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def same(a, b):
    key = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    return key(a) == key(b)


def test_statistics_and_filters(table):
    assert same(quality.robust_outliers(table), quality.robust_outliers(own(table)))
    kept = quality.filter_documents(table)
    assert kept.columns == table.columns and same(own(kept), quality.filter_documents(own(table)))
    assert {r["spans"] for r in kept.select("spans").collect()} == {"mine spans"}
    assert quality.filter_documents(table.limit(0)).count() == 0


def test_languages(table):
    model = langid.train(table)
    told = langid.identify(table, model)
    assert told.count() == table.count() and told.columns.count("score") == 1
    assert same(own(langid.filter_documents(table, model)), langid.filter_documents(own(table), model))
    verdict = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in told.collect()}
    assert verdict[200] == verdict[201] == verdict[202] == verdict[203] == ("und", 0.0) and verdict[300][0] in ("de", "en")
    assert langid.identify(table.limit(0), model).count() == 0


def test_near_duplicates(table):
    assert same(neardup.near_duplicates(table), neardup.near_duplicates(own(table)))
    first = neardup.first_of_each_group(table)
    assert first.columns == table.columns and same(own(first), neardup.first_of_each_group(own(table)))
    ids = [r["doc_id"] for r in first.collect()]
    assert ids.count(4) == 1 and 200 in ids and 300 in ids and ids.count(None) == 2  # the copy of row 5 goes; one with a text of its own and one without any stay


def test_scans(table):
    assert same(own(secrets.redact_documents(table)), own(table)) and secrets.redact_documents(table).columns == table.columns
    assert secrets.scan(table).count() == table.count() and secrets.scan(table.limit(0)).count() == 0


def test_tokens(table):
    packed = packing.pack(table).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 300) == max(r["doc_tokens"] for r in packed if r["doc_id"] == 300) > LONG
    assert sum(r["start"] == 0 for r in packed) == table.count()
    counts = separators.token_counts(table).collect()
    assert len(counts) == table.count() and {r["n_tokens"] + 1 for r in counts if r["doc_id"] == 300} == {r["doc_tokens"] for r in packed if r["doc_id"] == 300}
    coded = lexicon.encode(table, lexicon.build(table))
    assert coded.count() == table.count() and {r["n_tokens"] for r in coded.where("doc_id = 300").collect()} and coded.columns.count("ids") == 1
    assert packing.pack(table.limit(0)).count() == separators.token_counts(table.limit(0)).count() == 0


def test_scores(table):
    net = pseudo.Network(classes=8, per_class=16, shared=32, batch=512)
    got = pseudo.train_and_score(table, net=net).collect()
    assert len(got) == table.count() and {r["n_words"] for r in got if r["doc_id"] == 300} == {LONG}
    assert all(np.isfinite(r["pseudo_log_likelihood"]) for r in got)
    assert pseudo.train_and_score(table.limit(0), net=net).count() == 0


def test_pairs_and_neighbours(spark):
    turns = spark.createDataFrame([(1, "chosen", 0, "user", "hi " * LONG, "x"), (1, "chosen", 0, "user", "hi " * LONG, "x"), (1, "rejected", 0, None, None, "x"), (None, "chosen", 0, "user", "z", "x"), (2, None, 0, "user", "z", "x")], "pair_id long, side string, turn int, role string, text string, prompt string")
    (pair,) = chat.preference_pairs(turns).collect()
    assert pair["n_prompt_turns"] == 0 and pair["prompt"] == "" and len(pair["chosen"]) > 3 * LONG
    assert chat.preference_pairs(turns.limit(0)).count() == 0
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0], "x", 0.5) for i in [*range(40), 20, 20]], "vec_id long, embedding array<float>, rank string, score double")
    found = ann.search(vectors, F.col("id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 20} and all(r["recall"] >= 0.9 for r in found)
    assert all(r["vec_id"] != r["query_id"] for r in found) and len(found) == 40


def test_pipeline(spark, table, tmp_path):
    """The same rows with and without clashing columns, and no rows at all."""
    for name, df in (("own", own(table)), ("clash", table), ("none", table.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    plain = corpus_pipeline.run(spark, f"{tmp_path}/own")
    pieces = lambda d: sorted(map(str, d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert pieces(plain) == pieces(corpus_pipeline.run(spark, f"{tmp_path}/clash"))
    ids = [r["doc_id"] for r in plain.where("start = 0").collect()]
    assert ids.count(4) == 1 and not {200, 201, 202, 203} & set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    columns = table.columns
    docs = spark.read.parquet(f"{tmp_path}/clash/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
