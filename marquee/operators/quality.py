"""Data-quality checks; each returns the rows that fail, or one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import words
from ..session import side_by_side
from .reports import STRIDE, unpack_neighbours


def exists_nonempty(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", (F.col("n_rows") > 0).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


def declared_once(pages: DataFrame, markers: list[str]) -> DataFrame:
    """Pages in which a marker does not occur exactly once."""
    found = [
        F.struct(F.lit(m).alias("marker"), F.regexp_count("html", F.lit(_quote(m))).alias("found")) for m in markers
    ]
    return pages.select("page_id", F.inline(F.array(*found))).filter(F.col("found") != 1)


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


def stats_match(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Kinds whose stored count is not the recomputed one."""
    both = stored.select("kind", F.col("n").alias("stored")).join(current.select("kind", F.col("n").alias("current")), "kind", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("current")))


def references(pages: DataFrame) -> DataFrame:
    """(ref, first page) of every link and source on the pages."""
    refs = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(refs).alias("ref")).groupBy("ref").agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("uses")
    )


def unresolved(used: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """Used but never defined: set difference that keeps where it was first used."""
    return used.join(defined.select(key).distinct(), key, "left_anti")


def stamp_consistency(rows: DataFrame, group: str, stamp: str) -> DataFrame:
    """Groups whose rows carry more than one stamp."""
    per = rows.groupBy(group).agg(
        F.countDistinct(stamp).alias("stamps"), F.min(stamp).alias("low"), F.max(stamp).alias("high"), F.count("*").alias("n")
    )
    return per.filter(F.col("stamps") != 1)


def visible_text(html: Column) -> Column:
    """A page without embedded data, scripts and styles."""
    t = F.regexp_replace(html, r"(?s)const [A-Z]+ = \[.*?\];\n", "")
    t = F.regexp_replace(t, r"(?s)<script.*?</script>", "")
    return F.regexp_replace(t, r"(?s)<style.*?</style>", "")


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def hardcoded_counts(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages whose visible text states one of the catalogue counts. `counts` has one row per
    kind; they ride along as an array."""
    numbers = counts.filter("n > 0").agg(F.array_sort(F.collect_set("n")).alias("numbers")).withColumn("_one", F.lit(1))
    text = pages.select("page_id", visible_text(F.col("html")).alias("text")).withColumn("_one", F.lit(1))
    edge = "[A-Za-z0-9_]"

    def stated(n: Column) -> Column:
        plain = F.concat(F.lit(f"(?<!{edge})"), n.cast("string"), F.lit(f"(?!{edge})"))
        return F.contains(F.col("text"), grouped_number(n)) | F.rlike(F.col("text"), plain)

    joined = text.join(F.broadcast(numbers), "_one")
    return joined.select("page_id", F.explode(F.filter("numbers", stated)).alias("number"))


def index_alignment(ids: DataFrame, slim: DataFrame, packed: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts per kind agree with the slim index and the artefact's metadata, offsets are running sums
    of the counts in the order of the offsets, packed text is complete, and every packed number is
    that of an item. The slot width is the metadata's."""
    width = meta.agg(F.max("digits")).first()[0] or 3
    a = ids.groupBy("kind").agg(F.count("*").alias("a"), F.min("gid").alias("low"), F.max("gid").alias("high"))
    b = slim.groupBy("kind").agg(F.count("*").alias("b"))
    # One row per kind of item: a handful.
    before = W.orderBy("offset", "kind").rowsBetween(W.unboundedPreceding, -1)
    m = meta.select("kind", "offset", F.col("n").alias("m"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("due"))
    per = a.join(b, "kind", "full").join(m, "kind", "full").agg(
        F.count_if(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("a").eqNullSafe(F.col("m"))).alias("count_gaps"),
        F.count_if(
            ~F.col("offset").eqNullSafe(F.col("due"))
            | ~F.col("low").eqNullSafe(F.col("offset"))
            | (F.col("high") - F.col("low") + 1 != F.col("a"))
        ).alias("offset_gaps"),
    )
    n = ids.agg(F.count("*").alias("n"))
    length = side_by_side(packed.agg(F.sum(F.length("packed")).alias("len")), n).select(
        (F.coalesce("len", F.lit(0)) != F.col("n") * STRIDE * (width + 1)).cast("long").alias("length_gaps")
    )
    slots = unpack_neighbours(packed, width).withColumn("_one", F.lit(1))
    stray = slots.join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one").agg(
        F.count_if((F.col("neighbour") < 0) | (F.col("neighbour") >= F.col("n"))).alias("stray")
    )
    one = side_by_side(per, length, stray)
    names = ["count_gaps", "offset_gaps", "length_gaps", "stray"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("bad")) for c in names])))


def required_title(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count_if(F.coalesce("title", F.lit("")) == "").alias("untitled"), F.count("*").alias("n"))


def undefined_tokens(used: DataFrame, place: str, defined: DataFrame) -> DataFrame:
    """Words of `used(text)` that no text of `defined` has, with the first place they occur."""
    tokens = used.select(place, F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(
        F.min(place).alias("first_place")
    )
    known = defined.select(F.explode(words(F.col("text"))).alias("token"))
    return unresolved(tokens, known, "token")


def check_row(name: str, failing: DataFrame, severity: str = "fail") -> DataFrame:
    """One row per check: number of failing rows and how bad that is."""
    return failing.agg(F.count("*").alias("bad")).select(
        F.lit(name).alias("check"), "bad", F.when(F.col("bad") == 0, "ok").otherwise(severity).alias("severity")
    )


def severity_report(checks: list[DataFrame]) -> DataFrame:
    """All checks, and the worst of them in the row `overall`."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    level = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    worst = out.agg(F.sum("bad").alias("bad"), F.max(level).alias("l")).select(
        F.lit("overall").alias("check"), "bad",
        F.when(F.col("l") == 2, "fail").when(F.col("l") == 1, "warn").otherwise("ok").alias("severity"),
    )
    return out.unionByName(worst)


def fingerprint(rows: DataFrame, id_col: str, content: Column, volatile: str | None = None, digits: int = 10) -> DataFrame:
    """Ten hex digits over (id, content) in id order, volatile parts blanked out.

    Rows are hashed, then 4,096 hashes at a time by id range, level by level, so that no
    group ever holds more than 4,096 hashes (ids are unique). Ids beyond 2^60 or below 0 leave a few
    roots, which are hashed together; a row without an id is an error; no rows give no fingerprint."""
    body = F.coalesce(content, F.lit(""))
    if volatile:
        body = F.regexp_replace(body, volatile, "")
    own_id = F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit(f"a row without {id_col}")).cast("long"))
    level = rows.select(own_id.alias("_id"), F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(":"), body), 256).alias("_h"))
    for _ in range(5):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_id", "_h"))), lambda s: s["_h"])
        level = (
            level.groupBy(F.shiftright("_id", 12).alias("_up"))
            .agg(F.sha2(F.array_join(ordered, ""), 256).alias("_h"))
            .select(F.col("_up").alias("_id"), "_h")
        )
    roots = level.agg(F.array_sort(F.collect_list(F.struct("_id", "_h"))).alias("rs")).filter(F.size("rs") > 0)
    hashes = F.transform("rs", lambda s: s["_h"])
    whole = F.when(F.size("rs") == 1, hashes[0]).otherwise(F.sha2(F.array_join(hashes, ""), 256))
    return roots.select(F.substring(whole, 1, digits).alias("fingerprint"))


def inputs_fingerprint(inputs: list[tuple[str, DataFrame]], digits: int = 10) -> DataFrame:
    """One fingerprint over several inputs in the given order: their names and their own full
    fingerprints (frames of one row from fingerprint(..., digits=64)); an input without rows counts by its name."""
    parts = None
    for place, (name, own) in enumerate(inputs):
        one = own.agg(F.max("fingerprint").alias("own")).select(F.lit(place).alias("place"), F.lit(name).alias("name"), F.coalesce("own", F.lit("")).alias("own"))
        parts = one if parts is None else parts.unionByName(one)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "own"))), lambda s: F.concat(s["name"], F.lit(":"), s["own"]))
    return parts.agg(F.substring(F.sha2(F.array_join(joined, "|"), 256), 1, digits).alias("fingerprint"))


def publish(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """fingerprint and published: false where the stored fingerprint (a frame of at most one row) is
    the same, so that nothing need be written."""
    old = previous.agg(F.max("fingerprint").alias("_old"))
    return side_by_side(fresh, old).select("fingerprint", (~F.col("fingerprint").eqNullSafe(F.col("_old"))).alias("published"))
