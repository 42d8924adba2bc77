"""Preference formatting of chosen and rejected conversations, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .minhash import MOST_BUCKETS, bucket_of

# How a turn is rendered, and whose turns are trained on.
TURN = "<|{role}|>\n{text}<|end|>\n"
TRAINED = "assistant"
#: Numbers of conversations that one window orders.
ID_BUCKET = 100_000


def _render(turns: Column) -> Column:
    """All turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Start and end (code points, end exclusive) of each trained turn's text and end mark in the rendered completion."""
    size = lambda t: F.length(t["text"]) + F.length(t["role"]) + F.lit(13)  # noqa: E731  "<|" "|>\n" "<|end|>\n"
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = (acc["at"] + size(t)).cast("int")
        span = F.struct((acc["at"] + F.length(t["role"]) + F.lit(5)).cast("int").alias("start"), (end - F.lit(1)).cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def _turn() -> Column:
    """A turn's place, role and text, in the order by which turns stand."""
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _formatted(sides: DataFrame) -> DataFrame:
    """The result for pairs whose turns stand in order in the arrays ``a`` (chosen) and ``b`` (rejected)."""
    both = F.least(F.size("a"), F.size("b"))
    differ = F.filter(
        F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at("a", i)["role"] != F.element_at("b", i)["role"]) | (F.element_at("a", i)["text"] != F.element_at("b", i)["text"]),
    )
    cut = sides.withColumn("n_prompt", F.when(F.size(differ) > 0, F.element_at(differ, F.lit(1)) - 1).otherwise(both))
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.size(c))
    parts = cut.select("pair_id", "chosen_id", "rejected_id", "n_prompt", F.slice("a", F.lit(1), F.col("n_prompt")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    known = lambda of, c: F.when(F.col(of).isNotNull(), c)
    return parts.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt").cast("long").alias("n_prompt"), _render(F.col("p")).alias("prompt"),
        known("chosen_id", _render(F.col("a"))).alias("chosen"), known("rejected_id", _render(F.col("b"))).alias("rejected"),
        known("chosen_id", _mask(F.col("a"))).alias("chosen_mask"), known("rejected_id", _mask(F.col("b"))).alias("rejected_mask"),
    )


def format_pairs(conversations: DataFrame, pair: Column | None = None, chosen: Column | None = None) -> DataFrame:
    """One row for each pair: the longest common turn prefix once as ``prompt``, and both completions with their masks.

    ``pair`` names the pair of a conversation and ``chosen`` says whether it is the preferred side; by default
    conversations 2k and 2k+1 are a pair and the even one is chosen, as in tables that store the two answers one after the
    other. Two turns are equal if role and text are. Turns go by ``turn`` (null first), then role and text; a repeated row
    counts once. A null text is empty, a null role is ``user``. Rows without conv_id belong to no conversation and are
    left out. Where a side is missing, its id and completion are null, the prefix is empty and nothing is shared. If one
    side is a prefix of the other, its completion is empty. An empty table gives an empty result. Columns besides the
    four are not read. Each pair is one shuffled group, as long as its two conversations; no group holds more.
    """
    pair = F.expr("(conv_id - pmod(conv_id, 2)) div 2") if pair is None else pair
    chosen = (F.expr("pmod(conv_id, 2)") == 0) if chosen is None else chosen
    rows = conversations.where(F.col("conv_id").isNotNull()).select(pair.cast("long").alias("pair_id"), chosen.alias("is_chosen"), F.col("conv_id").cast("long").alias("conv_id"), _turn().alias("t"))
    side = lambda flag, c: F.when(F.col("is_chosen") == flag, F.col(c))
    grouped = rows.groupBy("pair_id").agg(
        F.max(side(True, "conv_id")).alias("chosen_id"), F.max(side(False, "conv_id")).alias("rejected_id"),
        F.collect_list(side(True, "t")).alias("a"), F.collect_list(side(False, "t")).alias("b"),
    )
    return _formatted(grouped.select("pair_id", "chosen_id", "rejected_id", *(F.array_distinct(F.array_sort(c)).alias(c) for c in "ab")))


def _before(ids: DataFrame, bucket_rows: int) -> DataFrame:
    """``pair_id`` and the greatest id under it, ``before`` (null for the least); the given ids are distinct.

    Ids are dealt into buckets of neighbours, each ordered by itself; the greatest id of each bucket, one row a bucket, goes on
    to the next one that has ids.
    """
    k = max(1, min(MOST_BUCKETS, math.ceil(ids.count() / bucket_rows)))
    cuts = ids.agg(F.percentile_approx("pair_id", [i / k for i in range(1, k)], F.lit(max(10_000, 4 * k))).alias("b")).first()["b"] if k > 1 else None
    rows = ids.withColumn("bucket", bucket_of(sorted(set(cuts or [])), F.col("pair_id")))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("pair_id").alias("top")).collect())  # a row a bucket
    under = ids.sparkSession.createDataFrame([(b, top) for (_, top), (b, _) in zip(tops, tops[1:], strict=False)], "bucket int, under long")
    beside = F.lag("pair_id").over(Window.partitionBy("bucket").orderBy("pair_id"))
    return rows.withColumn("beside", beside).join(F.broadcast(under), "bucket", "left").select("pair_id", F.coalesce("beside", "under").alias("before"))


def format_answers(conversations: DataFrame, role: str = TRAINED, bucket_rows: int = ID_BUCKET) -> DataFrame:
    """The same for a table without rejected answers: each conversation is chosen, and rejected is its copy whose last
    answer (turn of ``role``) is the last answer of the next conversation that has one, an answer to something else.

    ``pair_id`` and ``chosen_id`` are the conversation, ``rejected_id`` is whose answer the other side has; numbers may have
    any gaps. Without an answer of its own, or for the last conversation with an answer, there is no rejected side: all turns
    are the chosen completion. Where both answers and what follows them are equal, all is prompt and both completions are
    empty. All else is as in ``format_pairs``. Conversations are grouped once; answers are joined to them by the number, one
    row each; which conversation is next is found among numbers only, in buckets of about ``bucket_rows``.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("pair_id"), _turn().alias("t"))
    turns = rows.groupBy("pair_id").agg(F.array_distinct(F.array_sort(F.collect_list("t"))).alias("a"))
    last = F.array_max(F.filter(F.transform("a", lambda t, i: F.when(t["role"] == role, i + 1)), lambda i: i.isNotNull()))
    marked = turns.select("pair_id", "a", last.alias("last"))
    own = _before(rows.where(F.col("t.role") == role).select("pair_id").distinct(), bucket_rows).where("before IS NOT NULL")
    answers = marked.where("last IS NOT NULL").join(own, "pair_id").select(F.col("before").alias("pair_id"), F.col("pair_id").alias("of"), F.element_at("a", F.col("last"))["text"].alias("answer"))
    sides = marked.join(answers, "pair_id", "left")
    has = F.col("of").isNotNull()
    other = F.transform("a", lambda t, i: F.when(i + 1 == F.col("last"), t.withField("text", F.col("answer"))).otherwise(t))
    none = F.filter("a", lambda t: F.lit(False))
    return _formatted(sides.select("pair_id", F.col("pair_id").alias("chosen_id"), F.col("of").alias("rejected_id"), "a", F.when(has, other).otherwise(none).alias("b")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its copy with the next one's answer. Masks as text, ``start-end`` joined by commas, so that any engine can compare them."""
    out = format_answers(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.withColumns({c: flat(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


SQL = r"""
WITH c AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
l AS (SELECT conv_id, max(i) AS i FROM o WHERE role = 'assistant' GROUP BY 1),
z AS (SELECT conv_id, i, lead(conv_id) OVER (ORDER BY conv_id) AS of_, lead(i) OVER (ORDER BY conv_id) AS of_i FROM l),
x AS (SELECT z.conv_id, z.i, z.of_, y.text AS answer FROM z JOIN o AS y ON y.conv_id = z.of_ AND y.i = z.of_i),
n AS (SELECT conv_id, 0 AS side, i, role, text FROM o
      UNION ALL SELECT o.conv_id, 1, o.i, o.role, CASE WHEN o.i = x.i THEN x.answer ELSE o.text END FROM o JOIN x ON x.conv_id = o.conv_id),
differ AS (SELECT a.conv_id, min(a.i) AS i FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.i = b.i AND a.side = 0 AND b.side = 1 WHERE a.text <> b.text GROUP BY 1),
p AS (SELECT s.conv_id AS pair_id, s.conv_id AS chosen_id, x.of_ AS rejected_id,
        CAST(CASE WHEN x.conv_id IS NULL THEN 0 ELSE coalesce(d.i - 1, s.n_turns) END AS BIGINT) AS n_prompt
      FROM (SELECT conv_id, count(*) AS n_turns FROM o GROUP BY 1) s LEFT JOIN x ON x.conv_id = s.conv_id LEFT JOIN differ d ON d.conv_id = s.conv_id),
r AS (SELECT n.conv_id AS pair_id, n.side, n.i, n.role, n.i <= p.n_prompt AS shared, '<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10) AS s FROM n JOIN p ON p.pair_id = n.conv_id),
m AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_ FROM r),
g AS (SELECT pair_id, coalesce(string_agg(s, '' ORDER BY i) FILTER (shared AND side = 0), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT shared AND side = 0), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT shared AND side = 1), '') AS rejected,
  coalesce(string_agg(CAST(pos_ + length(role) + 5 AS BIGINT) || '-' || CAST(pos_ + length(s) - 1 AS BIGINT), ',' ORDER BY i) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(pos_ + length(role) + 5 AS BIGINT) || '-' || CAST(pos_ + length(s) - 1 AS BIGINT), ',' ORDER BY i) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
  FROM m GROUP BY 1)
SELECT pair_id, chosen_id, rejected_id, n_prompt, prompt, chosen,
  CASE WHEN rejected_id IS NOT NULL THEN rejected END AS rejected, chosen_mask, CASE WHEN rejected_id IS NOT NULL THEN rejected_mask END AS rejected_mask
FROM p JOIN g USING (pair_id)
"""
