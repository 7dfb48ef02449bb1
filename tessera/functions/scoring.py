"""Column expressions of scores and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def clamp01(c: Column) -> Column:
    """Bound to [0, 1]; not-a-number stays."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def popularity(stars: Column) -> Column:
    return F.when(stars <= 0, F.lit(0.0)).otherwise(clamp01(F.log10(stars + F.lit(1.0)) / 4))


def recency(updated: Column, as_of: Column) -> Column:
    """1 for 90 days, falling to 0 at 730; one half where there is no valid RFC 3339 time."""
    at = F.when(updated.rlike(RFC3339), F.try_to_timestamp(updated))
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at)) / F.lit(86_400e6)
    fall = F.when(days <= 90, F.lit(1.0)).when(days >= 730, F.lit(0.0)).otherwise(1 - (days - 90) / 640)
    return F.when(at.isNull(), F.lit(0.5)).otherwise(fall)


def completeness(m) -> Column:
    """Quarters: text, tools, a way to run it, categories."""
    parts = [(m("description") != "") | (m("enrichment")["summary"] != ""), F.size(m("tools")) > 0, (F.size(m("transports")) > 0) | (F.size(m("packages")) > 0), F.size(m("categories")) > 0]
    return sum((p.cast("int") for p in parts[1:]), parts[0].cast("int")) / F.lit(4.0)


def trust(m, as_of: Column) -> Column:
    return clamp01(0.4 * popularity(m("popularity")) + 0.3 * recency(m("updatedAt"), as_of) + 0.3 * completeness(m))


def coverage(matches: Column) -> Column:
    return F.when(matches <= 1, F.lit(0.0)).otherwise(1 - 1 / matches.cast("double"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def usage_score(calls: Column, successes: Column, tool_errors: Column) -> Column:
    """Smoothed success rate, weighed by the volume of calls."""
    rate = (successes + 0.5 * tool_errors + 1) / (calls + 2)
    return F.when(calls <= 0, F.lit(0.0)).otherwise(rate * F.least(F.lit(1.0), F.log10(calls + F.lit(1.0)) / 2))


def outcome(is_error: Column, error: Column) -> Column:
    return F.when(error.isNotNull() & (error != ""), "unreachable").when(is_error, "tool_error").otherwise("success")


def clamp_weights(trust: float, usage: float, cover: float) -> tuple[float, float, float]:
    """Each within [0, 1]; scaled down together if they sum to more than 1."""
    w = [min(1.0, max(0.0, x)) for x in (trust, usage, cover)]
    total = sum(w)
    return tuple(x / total for x in w) if total > 1 else tuple(w)


def clamped(trust: Column, usage: Column, cover: Column) -> list[Column]:
    """The same for weights in columns."""
    w = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in (trust, usage, cover)]
    total = F.greatest(F.lit(1.0), w[0] + w[1] + w[2])
    return [x / total for x in w]


def json_object(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def rank_order(raw: Column, n: Column) -> Column:
    """Distinct 1-based places within n of the list from the first ``[`` to the last ``]``; null if none is valid."""
    places = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<int>")
    valid = F.array_distinct(F.filter(places, lambda p: (p >= 1) & (p <= n)))
    return F.when(F.size(valid) > 0, valid)


def text_content(parts: Column) -> Column:
    """Text parts (type, text) joined by line feeds."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    joined = F.aggregate(texts, F.lit(""), lambda a, t: F.when(a == "", t).otherwise(F.concat(a, F.lit("\n"), t)))
    return joined


def client_transport(kind: Column, url: Column) -> Column:
    """How a remote endpoint is spoken to: streamable, sse or none."""
    k = F.lower(kind)
    return F.when(F.trim(url) == "", "none").when(k.isin("streamable-http", "streamable", "http"), "streamable").when(k == "sse", "sse").otherwise("none")
