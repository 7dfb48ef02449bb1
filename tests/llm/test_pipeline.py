"""The pipeline against its stages done plainly, and the queries that SQL can check."""

import os
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import langid, quality, queries, secrets
from tessera.llm.tokens import path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "MinHash near-dedup", "secret scans", "packing"]
    good = {r["doc_id"] for r in quality.robust_outliers(docs).where("kept").collect()}
    rows = docs.where(docs.doc_id.isin(*good)).orderBy("doc_id").collect()
    trees = langid.train(spark.createDataFrame(rows, docs.schema))
    told = {r["doc_id"] for r in langid.identify(spark.createDataFrame(rows, docs.schema), trees).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5 and r["bits_per_byte"] <= trees.limits.get(r["lang_pred"], 99)}
    rows = [r for r in rows if r["doc_id"] in told]

    def shingles(text):
        w = text.encode().lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        if find(r["doc_id"]) != r["doc_id"]:
            continue
        ids = [*tok.encode(secrets.redacted(r["text"], secrets.all_spans(r["text"])), add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[r["doc_id"], at, zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in got) == want
    assert 0 < len({r["doc_id"] for r in got}) < docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_language_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries.op4_language_trees(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(got) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.99
