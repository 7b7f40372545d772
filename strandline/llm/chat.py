"""Preference formatting: the longest common turn prefix of two conversations is rendered once as the prompt, and what is left of
each as its completion, with the spans that count for the loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The rendered form of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"
#: Neighbours for rejected replies are looked for among so many consecutive conversation numbers.
NEIGHBOURS = 1000


def safe(text: Column) -> Column:
    """A text in which no mark of the form can be forged: "<|" becomes "< |". A null text is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit(MIDDLE))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), safe(turn["text"]), F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """Where the learned turns' texts and closing marks stand in the rendered turns, in code points."""
    ends = F.aggregate(
        turns,
        F.array().cast("array<int>"),
        lambda done, t: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(_render(t)))),
    )
    both = F.zip_with(turns, ends, lambda t, e: F.struct((e - F.length(_render(t)) + F.length(_head(t))).alias("start"), e.alias("end"), t["role"].eqNullSafe(F.lit(LEARNED)).alias("learned")))
    return F.transform(F.filter(both, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["end"]))


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """One row for each conversation with its turns in order; turns of one number are ordered by role and text."""
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def preference(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """pair_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, trainable of every pair.

    Both frames have a row for each turn: key, turn, role, text; other columns are left alone and rows with a null key are left out.
    Turns are equal if role and text are (null equals null). A side that has no turns, or only the common ones, has an empty
    completion. trainable holds if the completions differ and the chosen one has a span. Both sides are grouped by the same key,
    so they are joined as they stand.
    """
    left = conversations(chosen, key).withColumnRenamed("turns", "c")
    right = conversations(rejected, key).withColumnRenamed("turns", "r")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    kind = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(t["turn"].cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text"))), none)
    both = left.join(right, "pair_id", "full").select("pair_id", kind(F.col("c")).alias("c"), kind(F.col("r")).alias("r"))
    equal = F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]), F.lit(False)))
    shorter = F.least(F.size("c"), F.size("r"))
    first = F.array_position(F.slice(equal, F.lit(1), shorter), F.lit(False))
    both = both.withColumn("p", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("p") + 1, F.size(c))
    parts = both.select("pair_id", "p", F.slice("c", F.lit(1), F.col("p")).alias("head"), rest("c").alias("c"), rest("r").alias("r"))
    out = parts.select(
        "pair_id", F.col("p").alias("prefix_turns"), _text(F.col("head")).alias("prompt"), _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )
    return out.withColumn("trainable", (F.col("chosen") != F.col("rejected")) & (F.size("chosen_spans") > 0))


def with_neighbour_replies(turns: DataFrame) -> DataFrame:
    """The same conversations with the last learned turn's text replaced by that of the next conversation: plausible, but to another question.

    Next is the next larger conv_id of the same NEIGHBOURS numbers, after the last the first. One alone keeps its reply.
    """
    named = turns.where(F.col("conv_id").isNotNull())
    per = named.groupBy("conv_id").agg(F.max(F.when(F.col("role") == LEARNED, F.struct("turn", "role", "text"))).alias("last"))
    w = W.partitionBy(F.floor(F.col("conv_id") / NEIGHBOURS)).orderBy("conv_id")
    following = F.coalesce(F.lead(F.struct("last")).over(w), F.first(F.struct("last")).over(w))["last"]["text"]
    swapped = per.withColumn("reply", F.coalesce(following, F.lit("")))
    # Turns of one conversation that repeat the last one, row for row, are all replaced.
    joined = named.join(swapped, "conv_id")
    last = F.struct("turn", "role", "text").eqNullSafe(F.col("last"))
    return joined.select("conv_id", "turn", "role", F.when(last & F.col("last").isNotNull(), F.col("reply")).otherwise(F.col("text")).alias("text"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")


#: The registered query as SQL.
SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, max(pos) AS at FROM t WHERE role = 'assistant' GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM t),
nxt AS (SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS partner FROM ids WINDOW w AS (PARTITION BY conv_id // 1000 ORDER BY conv_id)),
rep AS (SELECT nxt.conv_id, coalesce(t.text, '') AS reply FROM nxt LEFT JOIN m ON nxt.partner = m.conv_id LEFT JOIN t ON t.conv_id = m.conv_id AND t.pos = m.at),
b AS (SELECT t.conv_id, t.pos, t.role, t.text AS c, CASE WHEN t.pos = m.at THEN rep.reply ELSE t.text END AS r FROM t JOIN rep ON t.conv_id = rep.conv_id LEFT JOIN m ON t.conv_id = m.conv_id),
f AS (SELECT conv_id, coalesce(min(CASE WHEN c IS DISTINCT FROM r THEN pos END) - 1, max(pos)) AS p FROM b GROUP BY conv_id),
x AS (
  SELECT b.conv_id, pos, p, role, '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) AS h, replace(coalesce(c, ''), '<|', '< |') || '<|end|>' || chr(10) AS cb, replace(coalesce(r, ''), '<|', '< |') || '<|end|>' || chr(10) AS rb
  FROM b JOIN f ON b.conv_id = f.conv_id),
o AS (
  SELECT *, sum(CASE WHEN pos > p THEN length(h || cb) ELSE 0 END) OVER w AS ce, sum(CASE WHEN pos > p THEN length(h || rb) ELSE 0 END) OVER w AS re
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT conv_id AS pair_id, CAST(max(p) AS INT) AS prefix_turns, coalesce(string_agg(CASE WHEN pos <= p THEN h || cb END, '' ORDER BY pos), '') AS prompt,
    coalesce(string_agg(CASE WHEN pos > p THEN h || cb END, '' ORDER BY pos), '') AS chosen, coalesce(string_agg(CASE WHEN pos > p THEN h || rb END, '' ORDER BY pos), '') AS rejected,
    coalesce(string_agg(CASE WHEN pos > p AND role = 'assistant' THEN CAST(CAST(ce - length(cb) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ce AS BIGINT) AS VARCHAR) END, ';' ORDER BY pos), '') AS chosen_spans,
    coalesce(string_agg(CASE WHEN pos > p AND role = 'assistant' THEN CAST(CAST(re - length(rb) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(re AS BIGINT) AS VARCHAR) END, ';' ORDER BY pos), '') AS rejected_spans
  FROM o GROUP BY conv_id)
SELECT *, chosen <> rejected AND chosen_spans <> '' AS trainable FROM g
"""
