"""Contiguous shards of near-equal byte size, from prefix sums over range slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, shuffle_partitions

ROW_BYTES = 8


def contiguous_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                      carry: tuple[str, ...] = (), slices: int | None = None) -> DataFrame:
    """Deal all rows into ``n_shards`` runs of the id order whose byte sizes are near equal.

    Returns id, size, text_crc32, shard, slot and the columns in ``carry``.
    A row's size is its UTF-8 bytes plus 8 (null text: 8). The rows are cut
    into ``slices`` range partitions (default: spark.sql.shuffle.partitions);
    a slice's total needs one map-side aggregation, the running total over
    the totals gives each slice its offset, and a window inside each slice
    adds the rest. A row belongs to the shard in which its first byte falls
    when the whole is cut at equal targets, so a shard differs from the
    target by less than one row at either end.

    Null ids come first; rows with equal ids are ordered by checksum, size
    and place of reading, which also lets a very frequent id spread over
    slices. An empty table gives no rows; other columns of the input, whatever
    their names, are ignored unless carried (prefix ``_`` is reserved).
    """
    spark = docs.sparkSession
    keep = Staged(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = ["_id", "_crc", "_size", "_tag"]
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), F.monotonically_increasing_id().alias("_tag"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.repartitionByRange(slices or shuffle_partitions(spark), *order)
    sliced = keep(rows.withColumn("_slice", F.spark_partition_id()), "slices")

    totals = sliced.groupBy("_slice").agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = totals.select("_slice", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    whole = totals.agg(F.sum("_b").alias("_all"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    placed = (
        sliced.withColumn("_in", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_rn", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_slice")  # a row per slice: bounded by the number of slices
        .join(F.broadcast(whole))
        .withColumn("_shard", F.expr(f"cast((_b0 + _in) * {int(n_shards)} div _all as int)"))
        .withColumn("_row", F.col("_n0") + F.col("_rn"))
    )
    placed = keep(placed.drop("_slice", "_in", "_rn", "_b0", "_n0", "_all", "_tag"), "placed")
    keep.drop("slices")
    first = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").select(  # a row per shard
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
