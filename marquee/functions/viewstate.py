"""Shareable view addresses: fragment to map, open token, links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import decode_component, encode_component


def fragment(url: Column) -> Column:
    """Everything after the first #, empty if there is none."""
    return F.regexp_extract(url, "#(.*)$", 1)


def _pairs(frag: Column) -> Column:
    parts = F.filter(F.split(frag, "&"), lambda kv: F.instr(kv, "=") > 1)
    return F.transform(
        parts,
        lambda kv: F.struct(
            decode_component(F.regexp_extract(kv, "^([^=]+)=", 1)).alias("key"),
            F.regexp_extract(kv, "^[^=]+=(.*)$", 1).alias("value"),
        ),
    )


def _last(frag: Column, key: str) -> Column:
    """Raw value of a key, null if absent; later pairs overwrite earlier ones. A plain regex
    serves unless some key is itself percent-encoded."""
    hits = F.filter(_pairs(frag), lambda p: p["key"] == key)
    coded = F.try_element_at(hits, F.lit(-1))["value"]
    plain = F.when(frag.rlike(f"(^|&){key}="), F.regexp_extract(frag, f"^(?:.*&)?{key}=([^&]*)", 1))
    return F.when(frag.rlike("(^|&)[^=&]*%[^=&]*="), coded).otherwise(plain)


def state_value(url: Column, key: str) -> Column:
    return decode_component(_last(fragment(url), key))


def state_map(url: Column) -> Column:
    """The whole fragment as a map; the last value of a repeated key wins."""
    pairs = _pairs(fragment(url))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: decode_component(
                F.try_element_at(F.filter(pairs, lambda p: p["key"] == k), F.lit(-1))["value"]
            ),
        ),
    )


def state_genres(url: Column) -> Column:
    g = state_value(url, "g")
    return F.when(F.coalesce(g, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(g, "~"))


def open_token(url: Column) -> Column:
    """The item to open; a plus sign means a blank here."""
    raw = _last(fragment(url), "open")
    return decode_component(F.replace(raw, F.lit("+"), F.lit(" ")))


def search_links(title: Column, year: Column, imdb_id: Column) -> Column:
    q = encode_component(F.concat(title, F.lit(" "), F.coalesce(year.cast("string"), F.lit("null"))))
    return F.struct(
        F.when(
            F.coalesce(imdb_id, F.lit("")) != "",
            F.concat(F.lit("https://www.imdb.com/title/"), imdb_id, F.lit("/")),
        )
        .otherwise(F.concat(F.lit("https://www.imdb.com/find/?q="), q))
        .alias("imdb_url"),
        F.concat(F.lit("https://www.rottentomatoes.com/search?search="), q).alias("rt_url"),
        F.concat(F.lit("https://www.metacritic.com/search/"), q, F.lit("/")).alias("mc_url"),
    )
