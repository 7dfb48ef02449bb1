"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex strings) always
count.  Weak candidates - account names, bare random-looking strings, service
endpoints - are reported only when complementary parts stand close together in
one scope: an interval join of identifiers with secrets, and of endpoints with
either, inside blocks of lines that no blank line separates.

Offsets are code points, ends exclusive.  Defined results for odd input: a null
text counts as empty and has no spans; spans of one text are ordered by start,
then kind, then end, ties included once; very long texts are scanned whole;
repeated rows are scanned alike; columns of other names pass through, one named
``spans`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, named_again, numbered, replacing

#: In the order that spans with the same start take.
KINDS = ("assign", "access", "hex", "account", "random", "endpoint")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
ACCOUNT = re.compile(r"""\b(?:client|account|tenant|user|access)_?(?:id|name|key_?id)?["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_.@-]{4,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>|]{4,}", re.I | re.A)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
#: Code points between two parts of one credential.
REACH = 300
LEAST_ENTROPY = 3.5

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MARK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def _looks_random(s: str) -> bool:
    kinds = any(c.isdigit() for c in s) + any("a" <= c <= "z" for c in s) + any("A" <= c <= "Z" for c in s)
    n = len(s)
    return kinds == 3 and -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= LEAST_ENTROPY


class _Parts:
    """Intervals ordered by start, for questions of nearness inside a scope, each answered by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(set(spans))
        self.starts = [s for s, _ in self.spans]
        self.reached = list(accumulate((e for _, e in self.spans), max))

    def meets(self, start: int, end: int) -> bool:
        """Does an interval overlap this one?"""
        i = bisect_left(self.starts, end)
        return i > 0 and self.reached[i - 1] > start

    def near(self, start: int, end: int, low: int, high: int) -> bool:
        """Is another interval within REACH, inside the scope [low, high)?  No interval crosses a scope's border."""
        i = bisect_left(self.starts, max(low, start - REACH))
        within = self.spans[i : min(i + 2, bisect_right(self.starts, min(high - 1, end + REACH)))]
        if any(x != (start, end) for x in within):
            return True
        return low < start - REACH and i > 0 and self.reached[i - 1] >= start - REACH


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans and the linked weak ones, ordered by start, kind and end."""
    base = base_spans(text)
    found = list(base)
    strong_ids = [(s, e) for k, s, e in base if k == "access"]
    strong_secrets = [(s, e) for k, s, e in base if k != "access"]
    assigned = ":" in text or "=" in text
    taken = _Parts([(s, e) for _, s, e in base])
    free = lambda s, e: not taken.meets(s, e)
    accounts = [(m.start(), m.end()) for m in ACCOUNT.finditer(text) if free(m.start(), m.end())] if assigned else []
    if strong_ids or accounts or strong_secrets:
        breaks = [m.start() for m in BLANK_LINE.finditer(text)]
        scope = lambda at: ((i := bisect_right(breaks, at)) and breaks[i - 1], breaks[i] if i < len(breaks) else len(text) + 1)
        identifiers = _Parts(strong_ids + accounts)
        randoms = [(m.start(), m.end()) for m in RANDOM.finditer(text) if free(m.start(), m.end()) and _looks_random(m[0])] if identifiers.spans else []
        secrets = _Parts(strong_secrets + randoms)
        accounts = [x for x in accounts if secrets.near(*x, *scope(x[0]))]
        randoms = [x for x in randoms if identifiers.near(*x, *scope(x[0]))]
        found += [("account", *x) for x in accounts] + [("random", *x) for x in randoms]
        if "://" in text:
            parts = _Parts(strong_ids + strong_secrets + accounts + randoms)
            ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
            found += [("endpoint", *x) for x in ends if parts.near(*x, *scope(x[0]))]
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with MARK in the place of each run of overlapping spans."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``df`` with ``spans`` (a column of that name is replaced); with ``redact`` the text becomes its redacted form."""
    df = replacing(df, "spans")
    schema = T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(SPAN))])
    at = df.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            columns, found, texts = list(batch.columns), [], []
            for value in columns[at]:
                value = value.as_py()
                spans = all_spans(value) if value else []
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                if redact:
                    texts.append(redacted(value, spans) if spans else value)
            if redact:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*batch.schema.names, "spans"])

    return df.transform(arrow_map, run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact_documents(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Every row of ``df`` with its columns; found spans are replaced and ``n_chars`` brought up to date."""
    place = lambda c: f"c{df.columns.index(c)}"
    out = scan(numbered(df), place(text), redact=True)
    if n_chars in df.columns:
        own = place(n_chars)
        out = out.withColumn(own, F.when(F.size("spans") > 0, F.char_length(place(text)).cast(df.schema[n_chars].dataType)).otherwise(F.col(own)))
    return named_again(out, df.columns)
