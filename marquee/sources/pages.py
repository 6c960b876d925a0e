"""Catalogues kept as JSON files or embedded in pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import ITEM
from ..session import fresh_path
from .splits import JsonItems, array_items, records, under_key

CORRUPT = "_corrupt_record"


def _parsed(rows: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """rows with the item in a column of text in its place; items that are no JSON are left out."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = rows.withColumn("_item", F.from_json(text, wide, {"columnNameOfCorruptRecord": CORRUPT}))
    rest = [c for c in rows.columns if c != text]
    return parsed.filter(F.col(f"_item.{CORRUPT}").isNull()).select(*rest, *[F.col(f"_item.{f.name}") for f in schema.fields])


def load_json(spark: SparkSession, path: str, key: str | None = None, schema: T.StructType = ITEM) -> DataFrame:
    """Items of files that each hold an array of objects, or an object with the array under `key`.
    A large file is read by many tasks; of a file that ends too early the items before its end are read."""
    found = records(spark, path, JsonItems(1 if key is None else 2))
    if key is not None:
        found = under_key(found, key)
    return _parsed(found.select("text"), "text", schema)


class EmbeddedItems:
    """Table function (page, name) -> (no, item): the objects of the JSON array after `const NAME =`, in one scan over its brackets and
    strings; brackets inside strings do not count. An array that never closes has no items."""

    def eval(self, page: str, name: str):
        if not page or name is None:
            return
        at = re.search(r"const " + re.escape(name) + r"\s*=\s*(?=\[)", page)
        if at:
            yield from enumerate(array_items(page, at.end()))


def register_embedded_items(spark: SparkSession) -> str:
    """Makes the table function available to SQL; returns its name."""
    spark.udtf.register("embedded_items", F.udtf(EmbeddedItems, returnType="no int, item string"))
    return "embedded_items"


def extract_embedded_array(pages: DataFrame, name: str, html: str = "html", schema: T.StructType = ITEM) -> DataFrame:
    """Items of every page that embeds the array, with the page's other columns."""
    spark = pages.sparkSession
    register_embedded_items(spark)
    rest = ", ".join(f"p.`{c}`" for c in pages.columns if c != html)
    found = spark.sql(
        f"SELECT {rest + ', ' if rest else ''}f.item AS _text FROM {{pages}} p, LATERAL embedded_items(p.`{html}`, :name) f",
        args={"name": name}, pages=pages,
    )
    return _parsed(found, "_text", schema)


def item_blocks(items: DataFrame, size: int = 256) -> DataFrame:
    """JSON arrays of at most `size` items, by ranges of positions."""
    cols = [c for c in items.columns if c != "kind"]
    return (
        items.groupBy("kind", F.floor(F.col("pos") / size).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*cols)).alias("j")))).alias("rows"))
        .select("kind", "block", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]")).alias("json"))
    )


def write_json_files(blocks: DataFrame, key: str | None = None) -> str:
    """One file per block, as an array or wrapped under `key`; returns the folder."""
    path = fresh_path(blocks.sparkSession, "json")
    body = F.col("json") if key is None else F.concat(F.lit('{"' + key + '":'), "json", F.lit("}"))
    blocks.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def embed_in_pages(blocks: DataFrame) -> DataFrame:
    """Pages with a block as a script constant between other markup."""
    head = F.lit('<html><head><script>var t="[";</script></head><body><script>\nconst ')
    tail = F.lit(";\n\nconst $ = s => document.querySelector(s);</script></body></html>")
    return blocks.select("block", F.concat(head, F.upper("kind"), F.lit(" = "), "json", tail).alias("html"))
