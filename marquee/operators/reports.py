"""Explanations, packing and reports over neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.packing import digits_for, pack_slot, unpack_axis, unpack_gid
from ..functions.scores import basis_label, score_band
from ..session import side_by_side
from .similarity import AXES

STRIDE = 3 * fixed.K_PER_MEDIUM


def dominant_axis(slots: DataFrame) -> DataFrame:
    """Most frequent axis among an item's neighbours (at most nine); of equals the one that
    got there first."""
    hits = slots.filter(F.col("axis") >= 0).groupBy("gid", "axis").agg(
        F.count("*").alias("hits"), F.max("slot").alias("reached")
    )
    best = F.max_by("axis", F.struct(F.col("hits"), -F.col("reached")))
    return hits.groupBy("gid").agg(best.alias("axis"))


def explain(slots: DataFrame) -> DataFrame:
    phrases = F.array(*[F.lit(fixed.AXIS_PHRASE[a]) for a in AXES])
    why = F.concat(
        F.lit("Mostly picked because both are "), F.element_at(phrases, F.col("axis") + 1), F.lit(".")
    )
    return dominant_axis(slots).select("gid", why.alias("reason"))


def decorate(slots: DataFrame, ids: DataFrame, slim: DataFrame) -> DataFrame:
    """Neighbours with title, year, score and what the score rests on."""
    shown = slim.join(ids.select("kind", "pos", "gid"), ["kind", "pos"]).select(
        F.col("gid").alias("neighbour"), F.col("kind").alias("neighbour_kind"), "title", "year", "score",
        score_band(F.col("score")).alias("band"),
        basis_label(F.col("kind"), F.col("verified") == 1).alias("basis"),
    )
    return slots.select("gid", "slot", "neighbour", "axis").join(shown, "neighbour")


def slot_digits(ids: DataFrame) -> int:
    """Digits of an item number in a packed slot."""
    return digits_for(ids.count())


def pack_neighbours(ids: DataFrame, slots: DataFrame, width: int) -> DataFrame:
    """gid -> nine fixed-width slots; an empty slot is all zeros."""
    cell = F.struct("slot", pack_slot(F.col("neighbour"), F.col("axis"), width).alias("cell"))
    rows = slots.groupBy("gid").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))  # at most nine
    empty = F.lit("0" * (width + 1))
    packed = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(STRIDE - 1)),
            lambda s: F.coalesce(F.try_element_at(F.col("cells"), s.cast("int")), empty),
        ),
        "",
    )
    return ids.select("gid").join(rows, "gid", "left").select(
        "gid", F.when(F.col("cells").isNull(), F.repeat(empty, STRIDE)).otherwise(packed).alias("packed")
    )


def unpack_neighbours(packed: DataFrame, width: int) -> DataFrame:
    step = width + 1
    slots = packed.select("gid", "packed", F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1))).alias("slot"))
    cell = F.substring(F.col("packed"), F.col("slot") * step + 1, F.lit(step))
    return (
        slots.withColumn("cell", cell)
        .filter(F.col("cell") != "0" * step)
        .select("gid", "slot", unpack_gid(F.col("cell"), width).alias("neighbour"), unpack_axis(F.col("cell"), width).alias("axis"))
    )


def thin_items(ids: DataFrame, slots: DataFrame) -> DataFrame:
    """Items with under three neighbours in all."""
    n = slots.groupBy("gid").agg(F.count("*").alias("picks"))
    return ids.select("gid").join(n, "gid", "left").select(
        "gid", F.coalesce("picks", F.lit(0)).alias("picks"), (F.coalesce("picks", F.lit(0)) < 3).alias("thin")
    )


def build_report(ids: DataFrame, slots: DataFrame, adapted: DataFrame) -> DataFrame:
    per = thin_items(ids, slots).agg(
        F.count("*").alias("items"), F.sum("picks").alias("filled"), F.count_if("thin").alias("thin")
    )
    percent = F.floor(F.col("filled") / (F.col("items") * STRIDE) * 100 + 0.5).cast("int")
    figures = per.select("items", "filled", percent.alias("fill_percent"), "thin")
    return side_by_side(figures, adapted.agg(F.count("*").alias("adaptations")))


def hub_report(ids: DataFrame, slots: DataFrame) -> DataFrame:
    inbound = slots.groupBy(F.col("neighbour").alias("gid")).agg(F.count("*").alias("inbound"))
    return ids.select("kind", "gid").join(inbound, "gid", "left").groupBy("kind").agg(
        F.coalesce(F.max("inbound"), F.lit(0)).alias("worst_hub"),
        F.round(F.count_if(F.col("inbound").isNull()) / F.count("*"), 6).alias("never_recommended"),
    )
