"""The neighbour artefact as tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..operators.reports import STRIDE, slot_digits
from .catalogue import kind_spans


def metadata(ids: DataFrame) -> DataFrame:
    """One row per kind: offset and count; axes, phrases, stride and the digits of an item number beside."""
    axes = F.array(*[F.lit(a) for a in fixed.AXES])
    phrases = F.array(*[F.lit(fixed.AXIS_PHRASE[a]) for a in fixed.AXES])
    return kind_spans(ids.select("kind")).select(
        "kind", "offset", "n", F.lit(STRIDE).alias("stride"), F.lit(slot_digits(ids)).alias("digits"), axes.alias("axes"), phrases.alias("phrases")
    )


def write_artifact(path: str, ids: DataFrame, packed: DataFrame, adapted: DataFrame) -> None:
    metadata(ids).withColumn("built", F.current_date()).coalesce(1).write.parquet(f"{path}/meta")
    packed.write.parquet(f"{path}/neighbours")
    adapted.write.parquet(f"{path}/adaptations")
