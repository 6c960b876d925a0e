"""Sketches of parts, merged in any way, against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators.sketches import figures, merged, sketched


def test_parts_say_what_the_whole_says(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", i % 7, rng.randrange(4000), rng.gauss(0, 1) if i % 5 else None) for i in range(30_000)]
    df = spark.createDataFrame([*rows, ("c", 0, None, None)], "kind string, day int, item int, value double")
    parts = sketched(df, ["kind", "day"], "item", "value")
    twice = merged(merged(parts.withColumn("half", F.col("day") % 2), ["kind", "half"]), ["kind"])
    by = lambda frame: {r["kind"]: r for r in figures(frame, [0.1, 0.5, 0.9]).collect()}
    whole, once, two = by(sketched(df, ["kind"], "item", "value")), by(merged(parts, ["kind"])), by(twice)
    for kind in ("a", "b"):
        own = sorted(v for k, _, _, v in rows if k == kind and v is not None)
        items = len({i for k, _, i, _ in rows if k == kind})
        for got in (whole[kind], once[kind], two[kind]):
            assert got["n"] == sum(k == kind for k, *_ in rows)
            assert got["distinct"] == pytest.approx(items, rel=0.064)
            for r in (0.1, 0.5, 0.9):
                assert sum(v <= got[f"q{round(100 * r)}"] for v in own) / len(own) == pytest.approx(r, abs=0.056)
    assert once["c"]["distinct"] == 0 and once["c"]["q50"] is None and once["c"]["n"] == 1
    assert merged(parts.limit(0), ["kind"]).count() == 0
