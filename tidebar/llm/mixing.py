"""Temperature mixing of sources: shares to a power, the power by bisection, weights as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Sources up to which the plan, one row a source, is broadcast; beyond, the join is left to Spark.
BROADCAST_SOURCES = 10_000
#: Rows of the table for each block: of one block a source, rows are put in order.
BLOCK_ROWS = 100_000
SECTIONS, ROUNDS = 32, 5
#: Production targets: half of the way to the entropy of even weights, unless a source would be repeated four times as often as another.
ENTROPY_BETWEEN, MAX_REPEAT = 0.5, 4.0


def n_tokens(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exponent(sources: DataFrame, entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    """The largest exponent in [0, 1] whose weights reach the entropy, or the smallest that keeps the repetition limit.

    Both measures fall as the exponent grows. Each round evaluates a grid of exponents in one aggregation over the sources and
    keeps the section in which the target lies, so no list of sources reaches the driver.
    """
    low, high = 0.0, 1.0
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        p = F.col("tokens") / F.lit(float(total))
        powers = sources.where("tokens > 0").select("tokens", p.alias("p"), F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        rows = powers.groupBy("i").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least")).orderBy("i").collect()
        if entropy is not None:
            good = [math.log(r["z"]) - grid[r["i"]] * r["s"] / r["z"] >= entropy for r in rows]  # true, then false
            k = max((i for i, g in enumerate(good) if g), default=None)
            if k is None:
                return low
            if k == SECTIONS:
                return high
            low, high = grid[k], grid[k + 1]
        else:
            good = [(r["most"] / r["least"] if budget is None else budget / total * r["most"] / r["z"]) <= max_repeat for r in rows]  # false, then true
            k = min((i for i, g in enumerate(good) if g), default=None)
            if k is None or k == 0:
                return grid[0] if k == 0 else high
            low, high = grid[k - 1], grid[k]
    return low if entropy is not None else high


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return [source.alias("source"), n_tokens(F.col(text_col)).alias("tokens"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("hi"), F.xxhash64(F.col(id_col), F.length(text_col), F.lit(seed + 2)).alias("hd")]


def _block(blocks: Column, seed: int) -> Column:
    """The place of a row's block among all numbers: of ``source`` and ``hi``."""
    return F.xxhash64("source", F.pmod("hi", blocks), F.lit(seed + 1))


def _between(sources: DataFrame, part: float) -> float | None:
    """The entropy ``part`` of the way from that of the shares (0) to that of even ones (1); None without tokens."""
    p = F.col("tokens") / F.lit(float(sources.agg(F.sum("tokens")).first()[0] or 1))
    r = sources.where("tokens > 0").agg(F.count("*").alias("n"), F.sum(-p * F.log(p)).alias("h")).first()
    return r["h"] + part * (math.log(r["n"]) - r["h"]) if r["n"] else None


def plan(docs: DataFrame, *, entropy: float | None = None, entropy_between: float | None = None, max_repeat: float | None = 4.0, budget: float | None = None, blocks: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: tokens, weight, epochs, and up to where its permutation is taken once more: ``whole``, ``blocks``, ``cut_block``, ``cut_row``.

    A source's rows are dealt by hash into ``blocks`` blocks (by default one for ``BLOCK_ROWS`` rows of the table, 1024 at least); blocks stand in the order of a second hash, rows of a block in
    that of a third. ``budget`` is in tokens; by default it is the smallest that takes each row once at least, so that no
    row is lost. Beyond whole passes, whole blocks are taken while they fit in the source's share, then rows of the next.
    A null source is the empty one. Sources without tokens have weight 0 and are passed once.

    The target is an ``entropy`` (or ``entropy_between``: how far from the shares' own to the greatest there is) or a
    repetition limit; with both, the limit goes first. Without either the weights are the shares.
    """
    rows = cut(docs.select(*_rows(docs, id_col, text_col, source_col, seed)))  # four numbers a row; the texts are read once
    blocks = blocks or max(1024, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("hb", _block(F.lit(blocks), seed))
    by_block = rows.groupBy("source", "hb").agg(F.sum("tokens").alias("tokens"))
    sources = cut(by_block.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    if entropy_between is not None:
        entropy = _between(sources, entropy_between)
    power = max((_exponent(sources, *t, budget) for t in ((entropy, None), (None, max_repeat)) if t != (None, None)), default=1.0)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(F.lit(0.0))
    sums = sources.agg(F.sum(raw).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw)).alias("cover")).first()
    z = sums["z"] or 1.0
    spent = float(budget) if budget is not None else (sums["cover"] or 0.0) * z
    epochs = F.when(F.col("tokens") > 0, F.round(F.lit(spent) * F.col("weight") / F.col("tokens"), 6)).otherwise(F.lit(1.0))
    shares = sources.withColumn("weight", raw / F.lit(z)).withColumn("epochs", epochs).withColumn("whole", F.floor("epochs").cast("long"))
    shares = shares.withColumn("left", F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens") + 1e-6)).select("source", F.col("tokens").alias("source_tokens"), "weight", "epochs", "whole", "left")
    order = Window.partitionBy("source").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)  # at most ``blocks`` rows a source
    begun = by_block.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(shares, "source")
    edge = begun.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("tokens"))).select("source", "hb", "before", "left")
    inside = rows.join(edge, ["source", "hb"])  # rows of one block a source
    upto = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "hb").orderBy("hd")))
    last = upto.where("upto <= left").groupBy("source").agg(F.max("hd").alias("cut_row"))
    return cut(shares.join(edge.select("source", F.col("hb").alias("cut_block")), "source", "left").join(last, "source", "left").select("source", "source_tokens", "weight", "epochs", "whole", F.lit(blocks).alias("blocks"), "cut_block", "cut_row"))


def mix(docs: DataFrame, steps: DataFrame, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: ``row`` (all columns of docs), ``source``, ``tokens``, ``pass`` (from 1) and ``slot``, by which a reader sorts.

    Each row comes ``whole`` times, and once more if it stands before its source's cut. Slots interleave sources in
    proportion within a pass: a row's slot is the place of its block and itself in the source's permutation, from 0 to 1,
    on top of the pass. Repeated rows are taken alike; empty tables give empty results.
    """
    small = steps.count() <= BROADCAST_SOURCES
    rows = docs.select(F.struct("*").alias("row"), *_rows(docs, id_col, text_col, source_col, seed))
    taken = rows.join(F.broadcast(steps) if small else steps, "source").withColumn("hb", _block(F.col("blocks"), seed))
    again = (F.col("hb") < F.col("cut_block")) | ((F.col("hb") == F.col("cut_block")) & (F.col("hd") <= F.col("cut_row")))
    copies = (F.col("whole") + F.coalesce(again, F.lit(False)).cast("long")).cast("int")
    place = (F.col("hb") / F.lit(2.0**64) + F.lit(0.5)) + (F.col("hd") / F.lit(2.0**64) + F.lit(0.5)) / F.col("blocks")
    return taken.withColumn("copies", copies).where("copies > 0").select("row", "source", "tokens", "weight", "epochs", "copies", F.explode(F.sequence(F.lit(1), "copies")).alias("pass"), place.alias("place")).withColumn("slot", F.col("pass") - 1 + F.col("place")).drop("place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and pass of the mixture: weights half way to even ones by entropy, no source repeated over four times as often as another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs, plan(docs, entropy_between=ENTROPY_BETWEEN, max_repeat=MAX_REPEAT))
    return out.select("row.doc_id", "source", "tokens", "weight", "epochs", "copies", "pass", "slot")
