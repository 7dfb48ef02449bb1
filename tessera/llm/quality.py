"""Quality rules: robust multivariate outliers of text statistics.

Each text becomes a vector of transformed statistics.  For every language and
source a minimum-covariance-determinant estimate of location and scatter is
found by concentration steps from three deterministic starts - two steps each,
then on from the best until the determinant stops falling - and texts whose
robust Mahalanobis distance is beyond a chi-square cut-off are rejected.

Duplicate lines and repeated words are counts, so their resolution is taken off
before their share is: one line that occurs twice and one window that does are
no deviation.  What is left is held against the spread that the cell has, with
a floor that lets each of the two reject by itself.

Everything is DataFrame expressions.  Statistics are fixed-point integers, so
sums do not depend on the order of rows; order statistics come from counts of
values, which combine on the map side, so no cell's rows ever meet in one task.

Defined results for odd input: null text counts as empty; a null language or
source is a value of its own; cells below ``min_rows`` are pooled by language,
then over everything, and where even that is too small only the base rules
decide; repeated rows are judged alike and rows that tie at the edge of a subset
all belong to it; texts of any length are read whole; other columns, whatever
their names, pass through ``filter_documents``; an empty table gives an empty
table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLANKS, attach, drop, materialize, text_or_empty

#: Names of the transformed statistics, each with the least standard deviation that an estimate may have.
FLOORS = {"word_length": 0.06, "symbols": 0.45, "punctuation": 0.25, "dup_lines": 0.40, "repeats": 0.40}
DIMS = len(FLOORS)
SCALE = 500
BINS = 2047
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    subset: float = 0.75
    #: Steps from every start; then steps at most of the best one, until no determinant falls by more than ``tolerance``.
    early: int = 2
    steps: int = 50
    tolerance: float = 1e-6
    min_rows: int = 50
    short_words: int = 40
    #: Median and 0.9999 quantile of chi-square with five degrees of freedom.
    chi_median: float = 4.351
    chi_cutoff: float = 25.74


def _joined(reach: int) -> Column:
    """Hashes of twice as many words: each with the one ``reach`` places on."""
    return F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + reach)))


def text_statistics(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` without ``text``, with the raw counts of each text.

    Windows are compared by 64-bit hashes within one text; their size is a power of two.
    """
    k = rules.window
    if k & (k - 1) or k < 1:
        raise ValueError("window must be a power of two")
    keep = [c for c in df.columns if c != text]
    body = df.select(*keep, text_or_empty(text).alias("_t"))
    body = body.select(*keep, "_t", F.array_remove(F.split("_t", BLANKS), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    body = body.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_t", r"[\p{L}\p{M}\p{N}\s]+", "")).cast("long").alias("_punct"),
        F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    reach = 1
    while reach < k:  # hashes of 2, 4, 8 ... words from those of half as many
        body = body.withColumn("_h", _joined(reach))
        reach *= 2
    body = body.withColumn("_h", F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (k - 1), F.lit(0))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    body = body.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, i, j: F.get("_s", j)["h"] == e["h"]
    body = body.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, i: F.coalesce(same(e, i, i - 1), F.lit(False)) | F.coalesce(same(e, i, i + 1), F.lit(False))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("_p", i + 1) - p, F.lit(k)))), F.lit(0), lambda a, x: a + x)
    body = body.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return body.select(*keep, *STATS, "_punct", "_lines", failed.alias("base_failed"))


def _vector(stats: DataFrame, rules: Rules) -> DataFrame:
    """Adds x0..: transformed statistics in units of 1/SCALE, and the cell of each row."""
    share = lambda a, b: F.log1p(100 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [
        F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("_punct", "word_chars"),
        share("_dup", "_lines"),
        share("_repeat", "n_words"),
    ]
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    beyond = lambda c, n: F.greatest(F.col(c) - n, F.lit(0))
    stats = stats.withColumns({"_dup": beyond("n_dup_lines", 1), "_repeat": beyond("n_repeat_words", 2 * rules.window)})
    return stats.withColumns({f"x{j}": F.round(v * SCALE).cast("long") for j, v in enumerate(values)} | {"_lang": part("lang"), "_cell": F.concat(part("lang"), F.lit("\x01"), part("source"))}).drop("_dup", "_repeat")


def _cells(vectors: DataFrame, rules: Rules) -> DataFrame:
    """Which estimate each cell uses: its own, its language's pool of small cells, or the pool of everything small."""
    n = vectors.groupBy("_lang", "_cell").agg(F.count("*").alias("n"))
    n = n.withColumn("own", F.when(F.col("n") >= rules.min_rows, F.col("_cell")).otherwise(F.concat(F.lit("lang\x01"), F.col("_lang"))))
    pool = n.groupBy("own").agg(F.sum("n").alias("m"))
    return n.join(pool, "own").select("_cell", F.when(F.col("m") >= rules.min_rows, F.col("own")).otherwise(F.lit("all")).alias("est"))


def _small(df: DataFrame, tag: str) -> DataFrame:
    """A stored table of a row or three for each cell, in a few files whatever the number of shuffle partitions."""
    return materialize(df.coalesce(8), tag)


PLACES = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _sums(prefix: str, names: list[str]) -> list[Column]:
    """Aggregates of the first and second moments of integer columns."""
    return [F.sum(n).alias(f"{prefix}s{j}") for j, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"{prefix}p{i}{j}") for i, j in PLACES]


def _scatter(prefix: str = "", n: str = "n") -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """Location and scatter from the sums."""
    mean = [F.col(f"{prefix}s{j}") / F.col(n) for j in range(DIMS)]
    return mean, {(i, j): F.col(f"{prefix}p{i}{j}") / F.col(n) - mean[i] * mean[j] for i, j in PLACES}


def _cholesky(scatter: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m, l, logdet from ``m`` (location) and ``c`` (lower triangle): the floor is added to the diagonal and the sum factored."""
    at = {place: k for k, place in enumerate(PLACES)}
    factors = []  # each refers to those before it
    for i, floor in enumerate(FLOORS.values()):
        for j in range(i + 1):
            rest = F.col("c")[at[i, j]] + F.lit((floor * SCALE) ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            factors.append((F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}")).alias(f"l{i}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00"))
    return scatter.select(*keys, "m", "c", *factors).select(*keys, "m", F.array(*[F.col(f"l{i}{j}") for i, j in PLACES]).alias("l"), (2 * logdet).alias("logdet"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    at = {place: k for k, place in enumerate(PLACES)}
    parts = []  # each refers to those before it
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col("m")[i]
        for k in range(i):
            rest = rest - F.col("l")[at[i, k]] * F.col(f"y{k}")
        parts.append((rest / F.col("l")[at[i, i]]).alias(f"y{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMS)), F.col("y0") * F.col("y0"))
    return rows.select("*", *parts).select(*rows.columns, total.alias("d2"))


def _bin(d2: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(64 * F.log1p(d2))).cast("int")


def _starts(vectors: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """est, start, m, l, logdet: medians with the spread of quartiles, the plain moments, and medians with the moments of bent values."""
    xs = [f"x{j}" for j in range(DIMS)]
    rows = attach(vectors, cells, ["_cell"], size=size)
    # exact, from counts of values that combine on the map side
    q = rows.groupBy("est").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{j}") for j, x in enumerate(xs)])
    middles = [F.col(f"q{j}")[1].alias(f"b{j}") for j in range(DIMS)]
    widths = [F.greatest((F.col(f"q{j}")[2] - F.col(f"q{j}")[0]) / 1.349, F.lit(floor * SCALE)).alias(f"w{j}") for j, floor in enumerate(FLOORS.values())]
    q = _small(q.select("est", *middles, *widths).join(cells, "est"), "quality-quartiles")
    bent = [F.round(1000 * F.tanh((F.col(f"x{j}") - F.col(f"b{j}")) / F.col(f"w{j}"))).cast("long").alias(f"z{j}") for j in range(DIMS)]
    seen = attach(vectors, q, ["_cell"], size=size).select("est", *xs, *bent, *[f"{c}{j}" for j in range(DIMS) for c in ("b", "w")])
    firsts = [F.first(f"{c}{j}").alias(f"{c}{j}") for j in range(DIMS) for c in ("b", "w")]
    sums = seen.groupBy("est").agg(F.count("*").alias("n"), *firsts, *_sums("x", xs), *_sums("z", [f"z{j}" for j in range(DIMS)]))
    mid = F.array(*[F.col(f"b{j}").cast("double") for j in range(DIMS)])
    mean, cov = _scatter("x")
    bent_cov = _scatter("z")[1]
    start = lambda k, m, c: F.struct(F.lit(k).alias("start"), m.alias("m"), F.array(*[c[p] for p in PLACES]).alias("c"))
    spread = {(i, j): F.col(f"w{i}") * F.col(f"w{j}") for i, j in PLACES}
    three = [
        start(0, mid, {(i, j): spread[i, j] if i == j else F.lit(0.0) for i, j in PLACES}),
        start(1, F.array(*mean), cov),
        start(2, mid, {p: bent_cov[p] / 1e6 * spread[p] for p in PLACES}),
    ]
    found = _small(_cholesky(sums.select("est", F.explode(F.array(*three)).alias("s")).select("est", "s.*"), ["est", "start"]), "quality-start")
    drop(q)
    return found


def _concentrate(vectors: DataFrame, cells: DataFrame, state: DataFrame, rules: Rules, size: int) -> DataFrame:
    """One concentration step of every (est, start): the estimate of the ``subset`` of rows that are nearest to the one before.

    Moments are summed for each bin of distances, so one pass gives both the
    cut and the moments below it.
    """
    keys, xs = ["est", "start"], [f"x{j}" for j in range(DIMS)]
    far = _distance(attach(vectors.select("_cell", *xs), cells.join(state, "est"), ["_cell"], size=size))
    bins = far.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"), *_sums("", xs))
    w = W.partitionBy(*keys)
    below = bins.withColumns({"_before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "_all": F.sum("n").over(w)}).where(F.col("_before") < F.ceil(F.col("_all") * rules.subset))
    names = [f"s{j}" for j in range(DIMS)] + [f"p{i}{j}" for i, j in PLACES]
    sums = below.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    mean, cov = _scatter()
    return _cholesky(sums.select(*keys, F.array(*mean).alias("m"), F.array(*[cov[p] for p in PLACES]).alias("c")), keys)


def fit(vectors: DataFrame, cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Minimum-covariance-determinant estimates: est, m, l, scale and rows of each estimate.

    ``early`` steps are made from every start; the best of each cell goes on
    until no cell's determinant falls any more.
    """
    n_cells = cells.count()
    state = _starts(vectors, cells, n_cells)
    for _ in range(rules.early):
        after = _small(_concentrate(vectors, cells, state, rules, 3 * n_cells), "quality-step")
        drop(state)
        state = after
    best = W.partitionBy("est").orderBy("logdet", "start")
    after = _small(state.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"), "quality-best")
    drop(state)
    state = after
    for _ in range(rules.steps):
        moved = _concentrate(vectors, cells, state, rules, n_cells).select("est", F.col("m").alias("_m"), F.col("l").alias("_l"), F.col("logdet").alias("_d"))
        less = F.col("_d") < F.col("logdet") - rules.tolerance
        pick = lambda new, old: F.when(less, F.col(new)).otherwise(F.col(old)).alias(old)
        after = _small(state.join(moved, "est").select("est", "start", pick("_m", "m"), pick("_l", "l"), pick("_d", "logdet"), less.alias("fell")), "quality-step")
        drop(state)
        state = after
        if not state.where("fell").limit(1).count():
            break
    far = _distance(attach(vectors, cells.join(state, "est"), ["_cell"], size=n_cells)).select("est", _bin(F.col("d2")).alias("bin"))
    mid = far.groupBy("est").agg(F.floor(F.percentile("bin", F.lit(0.5))).alias("mid"), F.count("*").alias("rows"))
    scale = F.greatest(F.expm1((F.col("mid") + 0.5) / 64) / rules.chi_median, F.lit(1.0))
    out = _small(state.join(mid.select("est", scale.alias("scale"), "rows"), "est").select("est", "m", "l", "scale", "rows"), "quality-estimates")
    drop(state)
    return out


def judge(vectors: DataFrame, cells: DataFrame, estimates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds ``distance`` (squared, consistent for normal data) and ``kept``.

    A text of n words counts n / (n + short_words) of its deviation.
    """
    far = _distance(attach(vectors, cells.join(estimates, "est"), ["_cell"], "left", size=cells.count()))
    weight = F.col("n_words") / (F.col("n_words") + rules.short_words)
    d = F.when(F.col("rows") >= rules.min_rows, F.col("d2") / F.col("scale") * weight * weight)
    return far.withColumn("distance", d).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= rules.chi_cutoff))


def _judged(df: DataFrame, carried: Column, text: str, lang: str, source: str, rules: Rules) -> DataFrame:
    """Statistics and verdict of each row beside ``carried``; texts are read once and never shuffled."""
    slim = df.select(carried.alias("_row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))
    vectors = materialize(_vector(text_statistics(slim, "_text", rules), rules), "quality-vectors")
    cells = _small(_cells(vectors, rules), "quality-cells")
    return judge(vectors, cells, fit(vectors, cells, rules), rules)


def robust_outliers(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",), rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``df``: ``keep``, raw counts, ``base_failed``, ``distance`` and ``kept``."""
    out = _judged(df, F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("_none")), text, lang, source, rules)
    return out.select(*[F.col(f"_row._k{i}").alias(c) for i, c in enumerate(keep)], *STATS, "base_failed", "distance", "kept")


def filter_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns.

    Rows are stored once beside their statistics, of which the estimates read
    only the columns that they need.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    out = _judged(df, F.struct(*[F.col(c).alias(n) for c, n in zip(df.columns, names)]), text, lang, source, rules)
    return out.where("kept").select(*[F.col(f"_row.{n}").alias(c) for c, n in zip(df.columns, names)])
