"""Expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import COMBINING, accent_table


def _definitions() -> dict[str, str]:
    src, dst, _ = accent_table()
    bare = f"translate(lower(coalesce(t, '')), '{src + COMBINING}', '{dst}')"
    norm = "trim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' '))"
    articles = r"(?<![a-z0-9_])(the|a|an)(?![a-z0-9_])"
    return {
        "strip_accents(t STRING) RETURNS STRING": f"translate(t, '{src + COMBINING}', '{dst}')",
        "fold_title(t STRING) RETURNS STRING": (
            f"regexp_replace(regexp_replace(replace({bare}, '&', ' and '), '{articles}', ' '), '[^a-z0-9]+', '')"
        ),
        "slugify(t STRING) RETURNS STRING": (
            "regexp_replace(regexp_replace(replace(regexp_replace(lower(t), '[\\'’]', ''), '&', ' and '), "
            "'[^a-z0-9]+', '-'), '^-|-$', '')"
        ),
        "norm_title(t STRING) RETURNS STRING": norm,
        "best_score(mc INT, imdb DOUBLE, rt INT) RETURNS INT": "coalesce(mc, CAST(floor(imdb * 10 + 0.5) AS INT), rt, 0)",
        "years_agree(a INT, b INT, slack INT) RETURNS BOOLEAN": "a IS NULL OR b IS NULL OR abs(a - b) <= slack",
        "fmt_year(y INT) RETURNS STRING": (
            "CASE WHEN y IS NULL THEN '—' WHEN y < 0 THEN concat(abs(y), ' BC') ELSE CAST(y AS STRING) END"
        ),
        "score_band(s INT, good INT, mid INT) RETURNS STRING": (
            "CASE WHEN s IS NULL THEN 'none' WHEN s >= good THEN 'good' WHEN s >= mid THEN 'mid' ELSE 'bad' END"
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the temporary functions and returns their names; the fuzzy scorer comes along
    as an Arrow function."""
    from ..operators.fuzzy import fuzzy_score

    names = []
    for head, body in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    spark.udf.register("fuzzy_score", fuzzy_score)
    return [*names, "fuzzy_score"]
