"""Filter orders by playing them through, and line dedup by its definition; both on awkward tables too."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as bounded
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audit, linedrop, queries

WORDS = "the of and a to in is was for on with river house stone light table water green seven paper cloud winter".split()
CLASHES = ["digest", "mask", "part", "n", "good", "block", "mark", "gone", "keeper", "n_lines", "n_dropped", "kept", "hi", "lo", "shard", "c0", "c1"]


# ---- filter orders


@bounded(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(0, 10**12), max_size=32))
def test_polynomial(counts):
    p = audit.Removal(counts, 5)
    corners = p.corners()
    gone = lambda s: sum(n for m, n in counts.items() if m & s)
    assert corners == [gone(s) for s in range(32)]
    for i in range(5):
        total = sum(gone(sum(1 << j for j in order[: order.index(i) + 1])) - gone(sum(1 << j for j in order[: order.index(i)])) for order in permutations(range(5)))
        assert p.shapley(i) * 120 == total
    x = [Fraction(k + 1, 7) for k in range(5)]  # between the corners: the chance to be removed if filters act by themselves
    value = lambda x: sum(a * np.prod([x[i] for i in range(5) if s >> i & 1] or [Fraction(1)]) for s, a in enumerate(p.coefficients))
    assert value(x) == sum(n * (1 - np.prod([1 - x[i] for i in range(5) if m >> i & 1] or [Fraction(1)])) for m, n in counts.items())


def played(rows, labels):
    """The report by running each order over the rows, document by document."""
    smallest = {}
    for doc, text, _ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    fails, out = defaultdict(list), {}
    for doc, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails[source or ""].append((f + "E" * (doc is not None and smallest[t] < doc), (doc, 1) in labels["quality"], (doc, 1) in labels["toxic"]))
    for part, docs in fails.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_orders(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    texts = [prose(rng.randrange(20, 120)) for _ in range(25)] + ["the " * 60, "AB CD " * 40, "", prose(60) + " 5%", "\v\f\x1c  x", "É" * 30, prose(3000)]
    rows = [(i, rng.choice(texts), rng.choice(["s0", "s1", None, "", "s2"])) for i in range(150)]
    rows += [(200, None, None), (201, None, "s0"), (None, texts[0], "s0"), (None, None, None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "s1"), (-5, "ab", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (900, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in audit.filter_audit(docs, said).collect()}
    known = {"quality": {(d, q) for d, q, _ in labels if d is not None}, "toxic": {(d, t) for d, _, t in labels if d is not None}}
    assert got == played(rows, known) and len(got) == 600 * len({r[2] or "" for r in rows})
    assert audit.filter_audit(docs.limit(0), said).count() == 0 and audit.filter_audit(docs, said.limit(0)).count() == len(got)


# ---- lines


@bounded(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_perfect_hash(n, seed):
    pair = np.unique(np.random.default_rng(seed).integers(0, 2**64, (n, 2), np.uint64), axis=0)
    hi, lo = pair[:, 0].copy(), pair[:, 1].copy()
    made = linedrop.PerfectHash.build(hi, lo)
    assert sorted(made.index(hi, lo)) == list(range(len(hi)))
    again = linedrop.PerfectHash.unpack(made.sizes, made.pack())
    assert (again.index(hi, lo) == made.index(hi, lo)).all()
    assert sum(made.sizes) <= 6 * len(hi) + 64 * len(made.sizes)


def test_perfect_hash_of_near_keys():
    hi = np.repeat(np.arange(300, dtype=np.uint64), 300)
    lo = np.tile(np.arange(300, dtype=np.uint64), 300)
    assert sorted(linedrop.PerfectHash.build(hi, lo).index(hi, lo)) == list(range(90_000))
    with pytest.raises(ValueError):
        linedrop.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def folded(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def expected(rows, min_chars=40, min_docs=5):
    holders, keeper = Counter(), {}
    for doc, text in rows:
        for key in {folded(x) for x in (text or "").split("\n")}:
            holders[key] += 1
            if doc is not None:
                keeper[key] = max(doc, keeper.get(key, doc))
    for doc, text in rows:
        before = (text or "").split("\n")
        loses = lambda k: len(k) >= min_chars and holders[k] >= min_docs and k in keeper and keeper[k] != doc
        left = [x for x in before if not loses(folded(x))]
        yield (doc, len(before), len(before) - len(left), "\n".join(left))


def told(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(7)
    common = ["A passage of forty code points or more, he said", "une ligne très longue, élevée et partagée ...", "x" * 39, "y" * 40, "é" * 39, "Ü" * 40, "İstanbul and other cities of the same country"]
    line = lambda: rng.choice([*common, "", " ", "short", f"a line of its own with the number {rng.randrange(10**9)}"])
    vary = lambda x: rng.choice(["", " ", "\t\v", "\r"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "  ", "\f"])
    rows = [(i, "\n".join(vary(line()) for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, common[0] + "\n" + common[0]), (503, common[0]), (None, common[0]), (None, None), (7, rows[7][1]), (-4, "z" * 50)]
    rows += [(None, "nobody has an id for this line, so that it stays everywhere")] * 6 + [(600 + i, "four documents hold this line, and that is not enough") for i in range(4)]
    rows += [(700, "\n".join(f"line {i % 3000} of a very long text that has many of them" for i in range(9000)) + "\n" + common[0])]
    return rows


def test_lines(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(3)
    want = sorted(expected(lined), key=str)
    assert told(linedrop.dedup_lines(docs)) == want
    assert told(linedrop.dedup_lines(docs, entries=64)) == want  # many blocks and shards
    assert sum(r[2] for r in want) > 100
    assert told(linedrop.dedup_lines(docs, 1, 2)) == sorted(expected(lined, 1, 2), key=str)
    clashing = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    out = linedrop.dedup_lines(clashing)
    assert told(out) == want and {r["keeper"] for r in out.select("keeper").collect()} == {"mine keeper"}
    assert linedrop.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linedrop.dedup_lines(docs, min_docs=70_000)


def test_index_answers_others(spark, lined):
    """Documents that the index has not seen: lines that it knows are found, the rest are not."""
    docs = spark.createDataFrame(lined, "doc_id long, text string")
    lines = linedrop.held_lines(docs)
    sent, index = linedrop.index_of(lines, entries=256)
    shards = index.count()
    assert shards > 4 and index.agg(F.sum("n")).first()[0] == len({folded(x) for _, t in lined for x in (t or "").split("\n") if len(folded(x)) >= 40})
    other = spark.createDataFrame([(9000, "a passage of forty code points or more, he said\n" + "a line that no document of the index has, at all")], "doc_id long, text string")
    asked = linedrop.held_lines(other)
    found = linedrop.probe(linedrop.probes(asked, linedrop.shards_of(index)), index).collect()
    assert len(found) == 1 and found[0]["keeper"] == max(d for d, t in lined if d is not None and "a passage of forty" in (t or "").lower())
    assert [r["doc_id"] for r in linedrop.losses(asked, spark.createDataFrame(found)).collect()] == [9000]


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op12_line_dedup(spark, sf).collect()}
    assert got == {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in expected(docs)}
    rows = queries.op11_filter_audit(spark, sf).collect()
    assert len(rows) == 600 * len({r["part"] for r in rows}) and {r["step"] for r in rows} == {1, 2, 3, 4, 5}
