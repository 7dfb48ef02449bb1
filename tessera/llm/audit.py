"""How filters that reject documents interact, in every order, by the multilinear extension.

Each document gets a mask of the filters that it fails.  For each part of the
corpus the masks are counted, and the counts are made into one polynomial with a
variable for each filter: at a corner (0 or 1 for each variable) it has the
number of documents that the filters at 1 remove together.  Differences of
corners tell what a filter removes after others.  The integral of a filter's
partial derivative along the diagonal is its Shapley value, a sum of exact
rationals; times the number of orders it is what the filter removes, summed over
all orders.

The five filters, on words without ASCII blanks: A under 50 words; B under 65 %
distinct words; C over 5 % capitals A-Z; D any of ``#$%&*|``; E a text that a
smaller doc_id has too, in the whole table.

Bounds: documents meet in no group.  Rows of one text are counted by map-side
aggregation, so a text or a source may have any share of the table; what is left
is one row for each text and part, then at most 32 for each part.  Every part
has its 600 result rows.

Defined results for odd input: a null text is an empty one, a null source the
part ''; a row without doc_id has no label, fails E never and lets no other fail
it; rows that repeat a doc_id and a text count one by one, and none is a copy of
the other; of several labels of a document any that says 1 holds; texts are
compared by their SHA-256; very long texts are taken whole; an empty table gives
no rows; other columns, whatever their names, are not used.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLANKS, arrow_map, materialize, text_or_empty

FILTERS = "ABCDE"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counts of each mask that the report needs, beside the number of documents.
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Removal:
    """The polynomial of the number of documents removed: one coefficient for each set of filters."""

    def __init__(self, counts: dict[int, int], size: int):
        """``counts``: documents by mask; bit i stands for filter i of ``size``."""
        above = [0] * (1 << size)
        for mask, n in counts.items():
            above[mask] += n
        for i in range(size):  # of each set, the documents that fail all of it
            for s in range(1 << size):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        self.size = size
        self.coefficients = [0] + [n if s.bit_count() % 2 else -n for s, n in enumerate(above[1:], 1)]

    def corners(self) -> list[int]:
        """Its value where the variables of a set are 1 and the others 0, for every set."""
        value = list(self.coefficients)
        for i in range(self.size):
            for s in range(1 << self.size):
                if s >> i & 1:
                    value[s] += value[s ^ 1 << i]
        return value

    def slope(self, i: int) -> list[int]:
        """The partial derivative in variable i on the diagonal, as coefficients of 1, t, t^2, ..."""
        powers = [0] * self.size
        for s, a in enumerate(self.coefficients):
            if s >> i & 1:
                powers[s.bit_count() - 1] += a
        return powers

    def shapley(self, i: int) -> Fraction:
        """What filter i removes, averaged over all orders: the integral of ``slope`` from 0 to 1."""
        return sum((Fraction(a, k + 1) for k, a in enumerate(self.slope(i))), Fraction(0))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of filters A to D."""
    t = F.col("t")
    words = F.filter(F.split(t, BLANKS), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty("text").alias("t")).withColumn("words", words)
    size, capitals = F.size("words"), F.length(t) - F.length(F.translate(t, LETTERS, ""))
    fails = (size < 50, 100 * F.size(F.array_distinct("words")) < 65 * size, 100 * capitals > 5 * F.length(t), t.rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(t, 256)).alias("digest"), mask.alias("mask"))


def _sums(n: Column, good: Column, toxic: Column) -> list[Column]:
    return [F.sum(c).alias(k) for k, c in zip(COUNTS, (n, good, toxic))]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents, labelled good ones and labelled toxic ones have it."""
    rows = materialize(failures(docs), "failures")
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("long")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    flag = lambda k: F.coalesce(F.max(k), F.lit(0).cast("long")).alias(k)
    named = rows.where("doc_id IS NOT NULL").join(said, "doc_id", "left").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"), flag("good"), flag("toxic"))
    n, good, toxic = F.col("n"), F.col("good") * F.col("n"), F.col("toxic") * F.col("n")
    texts = named.groupBy("digest", "part", "mask").agg(*_sums(n, good, toxic), F.min(F.struct("doc_id", n.alias("n"), good.alias("good"), toxic.alias("toxic"))).alias("first"))
    # the rows of the smallest id that has the text are no copies
    texts = texts.withColumn("least", F.min("first.doc_id").over(W.partitionBy("digest")) == F.col("first.doc_id"))
    own = texts.where("least").select("part", "mask", *[F.col(f"first.{c}").alias(c) for c in COUNTS])
    rest = [(F.col(c) - F.when(F.col("least"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in COUNTS]
    copies = texts.select("part", (F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), *rest)
    nameless = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", *[F.lit(0).cast("long").alias(c) for c in COUNTS[1:]])
    return own.unionByName(copies).unionByName(nameless).groupBy("part", "mask").agg(*_sums(*map(F.col, COUNTS))).where("n > 0")


def lines_of(masks: list[dict], filters: str = FILTERS):
    """The report's rows of one part, in the order of ``SCHEMA`` without the part."""
    n = len(filters)
    polynomials = {c: Removal({m["mask"]: m[c] for m in masks}, n) for c in COUNTS}
    removed = {c: p.corners() for c, p in polynomials.items()}
    total, every = sum(m["n"] for m in masks), (1 << n) - 1
    shares = [polynomials["n"].shapley(i) * factorial(n) for i in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = {c: v[after] - v[before] for c, v in removed.items()}
            fails = removed["n"][1 << i]
            yield ("".join(filters[j] for j in order), step, total - removed["n"][after], gone["n"], fails - gone["n"], removed["n"][every] - removed["n"][every ^ 1 << i], gone["good"], gone["toxic"], int(shares[i]))
            before = after


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of ``SCHEMA`` for every order of ``filters``; ``counts``: see ``mask_counts``."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # at most 2 ** len(filters) of them

    def run(batches):
        for batch in batches:
            for part, masks in zip(batch.column(0), batch.column(1)):
                rows = list(lines_of(masks.as_py(), filters))
                columns = [[part.as_py()] * len(rows), *map(list, zip(*rows))]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return parts.transform(arrow_map, run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters over ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic)."""
    return report(mask_counts(docs, labels))


_ORDERS = """letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5)"""

#: Each order is played through; nothing here knows the polynomial.
ORACLE = f"""
WITH {_ORDERS},
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs),
fails AS (SELECT part, doc_id,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(doc_id > first_id, false) THEN 'E' ELSE '' END AS failed FROM words),
kinds AS (SELECT part, failed, count(*) AS n,
    sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END) AS good,
    sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END) AS toxic FROM fails GROUP BY part, failed),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
played AS (SELECT k.part, k.failed, k.n, k.good, k.toxic, o.filter_order, o.step, o.f,
    contains(k.failed, o.f) AS bad, len(list_intersect(string_split(k.failed, ''), string_split(o.earlier, ''))) > 0 AND o.earlier <> '' AND k.failed <> '' AS gone FROM kinds k, steps o),
told AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM played GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""
