"""Base-36 packing of neighbour slots, in a width that the number of items sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits_for(n_items: int) -> int:
    """Base-36 digits that every number below n_items fits in; three at least."""
    digits = 3
    while 36**digits < n_items:
        digits += 1
    return digits


def b36(c: Column, width: int) -> Column:
    """A number that does not fit is an error, never cut."""
    text = F.lower(F.conv(c.cast("string"), 10, 36))
    wide = F.raise_error(F.concat(c.cast("string"), F.lit(f" does not fit into {width} base-36 digits"))).cast("string")
    return F.when(c.isNull(), None).when((c >= 0) & (F.length(text) <= width), F.lpad(text, width, "0")).otherwise(wide)


def pack_slot(gid: Column, axis: Column, width: int) -> Column:
    """Item index in `width` digits, then axis + 1 in one; an axis of -1 packs as 0."""
    return F.concat(b36(gid, width), b36(axis + 1, 1))


def unpack_gid(slot: Column, width: int) -> Column:
    return F.conv(F.substring(slot, 1, width), 36, 10).cast("long")


def unpack_axis(slot: Column, width: int) -> Column:
    return F.conv(F.substring(slot, width + 1, 1), 36, 10).cast("int") - 1
