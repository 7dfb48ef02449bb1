"""Preference formatting of chosen and rejected conversations.

A pair's longest common prefix of turns is rendered once, as the prompt; what
follows on either side is rendered as a completion with a mask: the spans of
assistant content, with the mark that ends it, on which a loss is computed.

Defined results for odd input: turns are ordered by turn, then role and text,
and repeated rows of a conversation count once; a null role is ``user`` and a
null text is empty; two equal conversations are all prompt, with empty
completions; where a side is missing its completion and mask are null and
nothing is common; rows with a null pair, side or turn are left out; an empty
table gives an empty table.  A conversation must fit a row, as its text does, and is rendered
whole; repeated pairs are one pair; columns other than the five named, and
clashing names among them, are not used.  Text is rendered as it is, marks and
all: which characters are template and which are content is told by the mask's
spans and the number of prompt turns, not by searching for marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"
SIDES = ("chosen", "rejected")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of assistant content in the rendered turns, in code points, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_head(t))
        end = start + F.char_length(t["text"]) + len(END)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(df: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, and each side's completion and mask, from a table of turns."""
    turns = df.where(F.col(pair).isNotNull() & F.col(turn).isNotNull() & F.col(side).isin(*SIDES)).select(
        F.col(pair).alias("pair_id"), F.col(side).alias("side"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t")
    )
    of = lambda s: F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("t")))).alias(s)
    both = turns.groupBy("pair_id").agg(*[of(s) for s in SIDES])
    bare = lambda s: F.transform(s, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(s)
    both = both.select("pair_id", *[bare(s) for s in SIDES])
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(first > 0, first - 1).otherwise(F.size("chosen"))
    both = both.withColumn("_n", common)
    rest = lambda s: F.slice(s, F.col("_n") + 1, F.size(s))
    given = lambda s, c: F.when(F.size(s) > 0, c)
    columns = [c for s in SIDES for c in (given(s, render(rest(s))).alias(s), given(s, mask(rest(s))).alias(f"{s}_mask"))]
    return both.select("pair_id", F.col("_n").cast("long").alias("n_prompt_turns"), render(F.slice("chosen", F.lit(1), F.col("_n"))).alias("prompt"), *columns)


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k as chosen and 2k + 1 as rejected side of pair k."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "turn", "role", "text")


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM t
), size AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM n GROUP BY pair_id
), joined AS (
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.i, y.i) AS i,
         coalesce(x.role = y.role AND x.text = y.text, false) AS same
  FROM (SELECT * FROM n WHERE side = 0) x FULL JOIN (SELECT * FROM n WHERE side = 1) y ON x.pair_id = y.pair_id AND x.i = y.i
), prefix AS (
  SELECT s.pair_id, coalesce(min(j.i) FILTER (NOT j.same) - 1, any_value(s.a)) AS k
  FROM size s LEFT JOIN joined j USING (pair_id) GROUP BY s.pair_id
), piece AS (
  SELECT n.*, p.k, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS body FROM n JOIN prefix p USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM piece WHERE i > k
), completion AS (
  SELECT pair_id, side, string_agg(head || body || chr(10), '' ORDER BY i) AS body,
         string_agg((begun + length(head)) || ':' || (begun + length(head) + length(body)), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
  FROM placed GROUP BY pair_id, side
), prompt AS (
  SELECT pair_id, string_agg(head || body || chr(10), '' ORDER BY i) AS prompt FROM piece WHERE side = 0 AND i <= k GROUP BY pair_id
)
SELECT s.pair_id, p.k::BIGINT AS n_prompt_turns, coalesce(q.prompt, '') AS prompt,
       CASE WHEN s.a > 0 THEN coalesce(c.body, '') END AS chosen, CASE WHEN s.a > 0 THEN coalesce(c.mask, '') END AS chosen_mask,
       CASE WHEN s.b > 0 THEN coalesce(r.body, '') END AS rejected, CASE WHEN s.b > 0 THEN coalesce(r.mask, '') END AS rejected_mask
FROM size s JOIN prefix p USING (pair_id) LEFT JOIN prompt q USING (pair_id)
LEFT JOIN completion c ON c.pair_id = s.pair_id AND c.side = 0 LEFT JOIN completion r ON r.pair_id = s.pair_id AND r.side = 1
"""
