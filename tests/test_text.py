import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.operators.points import point_id


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def fnv(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


@pytest.mark.parametrize("word", ["", "a", "search", "Üben", "日本語", "x" * 300])
def test_hash_of_terms(spark, word):
    assert one(spark, X.fnv1a(F.col("w")), w=word) == fnv(word)


@pytest.mark.parametrize(("raw", "want"), [("search_products", "search products"), ("getUserById", "get user by id"), ("list-channels", "list channels"), ("a.b/c", "a b c"), ("--", "")])
def test_humanize(spark, raw, want):
    assert one(spark, X.humanize(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw", ["https://github.com/Acme/Search.git", "git@github.com:acme/search", "http://www.github.com/acme/search/", "git+https://github.com/acme/search.git"])
def test_addresses_of_one_repository(spark, raw):
    assert one(spark, X.repository(F.col("s")), s=raw) == "github.com/acme/search"


@pytest.mark.parametrize(("raw", "want"), [(" One. Two.", "One"), (". starts so. stays", ". starts so. stays"), ("", ""), ("no end", "no end"), ("a!b", "a")])
def test_first_sentence(spark, raw, want):
    assert one(spark, X.first_sentence(F.col("s")), s=raw) == want


def test_sets_and_stop_words(spark):
    assert one(spark, X.ordered_set(F.col("a")), a=[" b", "a", "b ", "", "a"]) == ["b", "a"]
    assert one(spark, X.useful_topics(F.col("a")), a=["mcp", "Database", "AI", "search"]) == ["Database", "search"]
    assert one(spark, X.tokens(F.col("s"), X.SPARSE_STOP), s="Send an E-mail to THE customer!") == ["send", "e", "mail", "customer"]
    assert one(spark, X.term_set(F.col("s")), s="I want mail, mail") == ["mail"]
    assert one(spark, X.keywords(F.col("s")), s="zeta alpha data server alpha beta the mini") == ["alpha", "beta", "mini", "zeta"]


def test_point_ids_are_uuids(spark):
    assert one(spark, point_id(F.col("a"), F.lit("tool"), F.col("b")), a="id-1", b="run ü") == str(uuid.uuid5(uuid.NAMESPACE_URL, "id-1|tool|run ü"))


def test_priors(spark):
    as_of = F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    recency = lambda s: one(spark, S.recency(F.col("s"), as_of), s=s)
    assert recency("") == recency("2025-01-02") == recency("junk") == 0.5
    assert recency("2025-12-25T00:00:00Z") == recency("2027-01-01T00:00:00+02:00") == 1.0
    assert recency("2020-01-01T00:00:00Z") == 0.0 and 0 < recency("2025-01-01T00:00:00Z") < 1
    assert one(spark, S.popularity(F.col("n")), n=0) == 0.0 and one(spark, S.popularity(F.col("n")), n=10**6) == 1.0
    score = lambda c, s, e: one(spark, S.usage_score(F.col("c"), F.col("s"), F.col("e")), c=c, s=s, e=e)
    assert score(50, 50, 0) > score(50, 25, 25) > score(50, 0, 0) > score(0, 0, 0) == 0.0
    assert score(50, 50, 0) > score(1, 1, 0)


def test_weights():
    assert S.clamp_weights(0.6, 0.6, 0.6) == pytest.approx((1 / 3,) * 3)
    assert S.clamp_weights(-1, 2, 0.5) == pytest.approx((0, 2 / 3, 1 / 3))


def test_parsers(spark):
    assert one(spark, S.json_object(F.col("s")), s='say ```json\n{"a": {"b": 1}}\n``` ok') == '{"a": {"b": 1}}'
    assert one(spark, S.rank_order(F.col("s"), F.lit(3)), s="so [3, 1, 3, 9]") == [3, 1]
    assert one(spark, S.rank_order(F.col("s"), F.lit(3)), s="[7]") is None
    for kind, want in (("Streamable-HTTP", "streamable"), ("sse", "sse"), ("stdio", "none"), ("", "none")):
        assert one(spark, S.client_transport(F.col("k"), F.col("u")), k=kind, u="http://x") == want
    assert one(spark, S.client_transport(F.col("k"), F.col("u")), k="sse", u=" ") == "none"
    assert one(spark, S.outcome(F.col("e") == "yes", F.col("x")), e="yes", x="refused") == "unreachable"


def test_hashes_of_many_words_at_once():
    import pyarrow as pa

    from tessera.operators.encode import hashes

    words = ["a", "search", "Üben", "日本語", "x" * 300, "", "a", "𝔘nicode", "\0", "é" * 5000]
    assert hashes(pa.array(words)).tolist() == [fnv(w) for w in words] and hashes(pa.array(words).slice(2, 3)).tolist() == [fnv(w) for w in words[2:5]]
    assert hashes(pa.array([], pa.string())).tolist() == []


def test_words_are_counted_in_their_rows(spark):
    from collections import Counter

    from tessera.operators import encode

    texts = [(1, "The cat, the CAT and 3 cats"), (2, None), (3, ""), (4, " \n--"), (5, "Über ÜBER straße 日本語 日本語"), (6, "w " * 5000 + "z"), (1, "the end")]
    got = encode.word_counts(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t").collect()
    import regex

    want = Counter()
    for k, t in texts:
        for word, n in Counter(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())).items():
            want[k, word, fnv(word), n] += 1
    assert Counter(map(tuple, got)) == want
    assert encode.terms_of(spark.createDataFrame(got), "k", None).where(F.col("term") == fnv("the")).first()["tf"] == 3
    two = encode.word_counts(spark.createDataFrame([("a", True, "x y x")], "doc string, last boolean, text string"), ["doc", "last"], "text").collect()
    assert sorted((r["doc"], r["last"], r["word"], r["n"]) for r in two) == [("a", True, "x", 2), ("a", True, "y", 1)]


def test_bags_are_counted_in_bounded_parts(spark, monkeypatch):
    """However many rows a batch has, a task counts a bounded number of words at once; the whole counts stay the same."""
    import pyarrow as pa

    from tessera.operators import encode

    monkeypatch.setattr(encode, "AT_ONCE", 7)
    words = [["a", "b", "a"], ["the"], ["c"] * 20, ["a", "the", "d"], ["e"]] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(words)], names=["k", "_words"])
    for run, names in ((encode._counted(["k", "word", "term", "n"]), None), (encode._bagged(["k", *encode.BAG], ["the"]), encode.BAG)):
        out = list(run([batch.slice(0, 11), batch.slice(11)]))
        assert len(out) > 10 and sum(b.num_rows for b in out) == (20 if names else 4 * 8)
    held = pa.Table.from_batches(out).to_pylist()
    assert [(r["ts"], r["tf"], r["stop_tf"]) for r in held[:4]] == [(sorted([fnv("a"), fnv("b")]), [2, 1] if fnv("a") < fnv("b") else [1, 2], []), ([], [], [1]), ([fnv("c")], [20], []), (sorted([fnv("a"), fnv("d")]), [1, 1], [1])]


def test_bags_of_a_shared_key_are_one(spark):
    from tessera.operators import encode

    texts = [(1, "the cat CAT"), (2, None), (3, ""), (4, "the of"), (5, "straße 日本語 日本語"), (1, "the end cat"), (None, "x"), (None, "x y")]
    bag = encode.bags(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t")
    got = {(r["k"], t): n for r in bag.collect() for t, n in zip(r["ts"] + r["stop_ts"], r["tf"] + r["stop_tf"])}
    want = {(1, "the"): 2, (1, "cat"): 3, (1, "end"): 1, (4, "the"): 1, (4, "of"): 1, (5, "straße"): 1, (5, "日本語"): 2, (None, "x"): 2, (None, "y"): 1}
    assert got == {(k, fnv(w)): n for (k, w), n in want.items()} and bag.count() == 4
    longer = encode.embedded(bag, "k", 16).join(encode.dense_vectors(encode.hash_embedding(spark.createDataFrame(texts, "k int, t string"), "k", "t", 16), "k", 16).withColumnRenamed("vector", "v"), "k")
    assert longer.count() == 3 and longer.where("vector != v").count() == 0
