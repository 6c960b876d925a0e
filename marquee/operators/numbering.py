"""Dense numbering of unique ids without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STEP = 16  # bits per level: no window sees more than 65,536 rows


def dense_position(df: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """0-based position by a unique non-negative `id_col` within `keys`.

    A window over a key would put a hot key into one task. Ids are cut into
    blocks of 65,536; rows are numbered within a block, and block sizes are
    summed up within super-blocks of 65,536 blocks, and those within the key.
    """
    block = F.shiftright(F.col(id_col), STEP)
    tagged = df.withColumn("_b", block)
    sizes = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_s", F.shiftright("_b", STEP))
    in_super = Window.partitionBy(*keys, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_o1", F.coalesce(F.sum("_n").over(in_super), F.lit(0)))
    supers = sizes.groupBy(*keys, "_s").agg(F.sum("_n").alias("_m"))
    in_key = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.withColumn("_o2", F.coalesce(F.sum("_m").over(in_key), F.lit(0))).drop("_m")
    starts = sizes.join(supers, [*keys, "_s"]).select(*keys, "_b", (F.col("_o1") + F.col("_o2")).alias("_start"))
    local = Window.partitionBy(*keys, "_b").orderBy(id_col)
    return (
        tagged.withColumn("_r", F.row_number().over(local) - 1)
        .join(starts, [*keys, "_b"])
        .withColumn(out, F.col("_start") + F.col("_r"))
        .drop("_b", "_r", "_start")
    )
