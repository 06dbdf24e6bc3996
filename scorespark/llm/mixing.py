"""Temperature mixing of sources, realised as budgeted permutations of blocks. DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, refuse_columns

_SECTIONS, _PASSES = 16, 7  # each pass halves the exponent's interval four times


def _hash(*parts) -> Column:
    """A 60-bit number from the md5 of parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def temperature(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent a of weights w ~ p**a over the token shares p (column ``tokens``), to six digits.

    With ``max_repeats`` it is the smallest exponent of 0 to 1 at which no
    source is repeated more than that many times as often as the least
    repeated one; with ``entropy`` the one of 0 to 4 whose weights have that
    entropy in nats (the nearer end if none has). The interval is bisected;
    each pass over the table of sources, one row each, decides four halvings.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either an entropy or a repetition limit")
    known = shares.where("tokens > 0")
    total = known.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    lo, hi = 0.0, 1.0 if entropy is None else 4.0

    def flat_enough(points: list[float]) -> list[bool]:
        """At which exponents the weights have passed the target: true from some point on."""
        if entropy is None:
            least, most = known.agg(F.min(p), F.max(p)).first()
            return [(1 - a) * math.log(most / least) <= math.log(max_repeats) + 1e-12 for a in points]
        sums = [F.sum(F.pow(p, F.lit(a))) for a in points] + [F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in points]
        got = known.agg(*sums).first()
        return [math.log(z) - a * s / z <= entropy for a, z, s in zip(points, got, got[len(points):])]

    for _ in range(_PASSES):
        points = [lo + (hi - lo) * i / _SECTIONS for i in range(_SECTIONS + 1)]
        passed = flat_enough(points)
        if passed[0]:
            return round(points[0], 6)
        first = passed.index(True) if True in passed else _SECTIONS
        lo, hi = points[first - 1], points[first]
    return round(hi, 6)


def mix(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: float | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = 1024,
        seed: int = 0) -> DataFrame:
    """``docs`` with its columns and ``_tokens`` (words), ``_copies`` and ``_order``.

    Source token shares are raised to the exponent that ``temperature`` finds,
    and normalised. A source's quota is its weight of ``budget`` tokens; by
    default the budget is the smallest that lets every source be read whole,
    so no document is left out. A quota buys whole passes over the source and
    a part of one more. For that part the source's documents lie in ``blocks``
    hashed blocks, whose order is a seeded permutation, as is the order inside
    a block; blocks are bought until the quota ends, the last one document by
    document. ``_order`` is the block's place in that permutation: sorting by
    it interleaves the sources.

    Block totals and the one cut block of each source are all that is
    gathered: a source that holds a third of all rows costs ``blocks`` rows.
    Documents join only the row of their source.

    Null sources are a source of their own; null texts have no tokens; a
    source without tokens is read once. Rows with equal ids stand at the same
    place of the permutation and are bought together. An empty table gives no
    rows. Names that start with ``_`` are reserved.
    """
    spark = docs.sparkSession
    keep = Staged(spark, "mixing")
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("null"))
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    block = F.pmod(_hash(F.lit(seed), F.lit("block"), number), F.lit(blocks))
    refuse_columns(docs, "_tokens", "_copies", "_order", "_source", "_key")
    marked = (docs.withColumn("_tokens", tokens).withColumn("_source", name)
              .withColumn("_order", _hash(F.lit(seed), F.lit("order"), name, block))
              .withColumn("_key", _hash(F.lit(seed), F.lit("key"), number)))
    # the narrow columns once, so that texts are scanned for words a single time before the last pass
    narrow = keep(marked.select("_source", "_order", "_key", "_tokens"), "narrow")
    in_block = keep(narrow.groupBy("_source", "_order").agg(F.sum("_tokens").alias("t")), "blocks")
    shares = keep(in_block.groupBy("_source").agg(F.sum("t").alias("tokens")), "shares")

    a = temperature(shares, entropy, max_repeats)
    whole = shares.agg(F.max("tokens").alias("top"), F.sum("tokens").alias("total"))
    ratio = F.pow(F.col("tokens") / F.col("top"), F.lit(a))
    if budget is None:  # all of every source: the largest w / p is at the smallest share, the least at the largest
        quota = F.col("top") * ratio
    else:
        z = shares.crossJoin(F.broadcast(whole)).agg(F.sum(F.when(F.col("tokens") > 0, ratio))).first()[0] or 1.0
        quota = F.lit(float(budget)) * ratio / F.lit(z)
    plan = shares.crossJoin(F.broadcast(whole)).withColumn(  # one row
        "quota", F.when(F.col("tokens") > 0, F.floor(quota + F.lit(1e-6))).otherwise(0)).withColumn(
        "passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)).withColumn(
        "rest", F.col("quota") - F.when(F.col("tokens") > 0, F.col("passes") * F.col("tokens")).otherwise(0))
    plan = keep(plan.select("_source", "passes", "rest"), "plan")

    run = Window.partitionBy("_source").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)  # `blocks` rows
    cut = (in_block.withColumn("end", F.sum("t").over(run)).join(plan, "_source").where("end > rest")
           .groupBy("_source").agg(F.min("_order").alias("cut"), F.min("end").alias("end"), F.min_by("t", "_order").alias("t"),
                                   F.first("rest").alias("rest")))
    left = cut.select("_source", "cut", (F.col("rest") - (F.col("end") - F.col("t"))).alias("left"))
    inside = Window.partitionBy("_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    last = (narrow.join(left, "_source").where("_order = cut")  # one block of a source
            .withColumn("end", F.sum("_tokens").over(inside)).where("end <= left")
            .groupBy("_source").agg(F.max("_key").alias("last")))
    rules = keep(plan.join(left, "_source", "left").join(last, "_source", "left").select(
        "_source", "passes", "cut", "last"), "rules")

    bought = F.expr("cut is null or _order < cut or (_order = cut and coalesce(_key <= last, false))")
    out = marked.join(rules, "_source").withColumn("_copies", F.col("passes") + F.when(bought, 1).otherwise(0))
    # without a cut block the rest would buy the whole source, which only an empty one allows
    out = out.withColumn("_copies", F.when(F.col("cut").isNull(), F.col("passes")).otherwise(F.col("_copies")).cast("long"))
    return out.select(*docs.columns, "_tokens", "_copies", "_order")
