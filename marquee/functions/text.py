"""Text keys: folding, slugs, titles, words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

COMBINING = "".join(chr(c) for c in range(0x300, 0x370))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, str]:
    """(from, to, expanding): characters whose decomposition minus U+0300-036F is one
    character, what they become, and a regex class of those that become several."""
    src, dst, wide = [], [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF or 0x300 <= code < 0x370:
            continue
        ch = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) < 0x370)
        if bare == ch:
            continue
        if len(bare) == 1:
            src.append(ch)
            dst.append(bare)
        elif len(bare) > 1:
            wide.append(code)
    runs: list[list[int]] = []
    for code in wide:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    cls = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    return "".join(src), "".join(dst), f"[{cls}]"


def strip_accents(c: Column) -> Column:
    """One to one for precomposed letters; combining marks are dropped."""
    src, dst, _ = accent_table()
    return F.translate(c, src + COMBINING, dst)


def fold_title(c: Column) -> Column:
    """Lower, no accents, & as and, no articles, only a-z and 0-9."""
    t = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, "&", " and ")
    t = F.regexp_replace(t, r"(?<![a-z0-9_])(the|a|an)(?![a-z0-9_])", " ")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def fold_loose(c: Column) -> Column:
    """Lower, no accents, only a-z and 0-9."""
    return F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "['’]", "")
    s = F.regexp_replace(s, "&", " and ")
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def base_title(c: Column) -> Column:
    """Franchise key: no leading article, no volume part, no trailing number."""
    t = F.regexp_replace(norm_title(c), "^(the|a|an) ", "")
    t = F.element_at(F.split(t, " (?:vol|volume|part|book|season|episode) "), 1)
    return F.trim(F.regexp_replace(t, r"\s+\d+$", ""))


def title_prefix8(c: Column) -> Column:
    return F.substring(norm_title(c), 1, 8)


def words(c: Column) -> Column:
    """ASCII letter runs of the lowered text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def period_signal(c: Column) -> Column:
    """Half a hit where the text names a year from 1000 to 2029."""
    # The first digit is looked for before what stands in front of it, which is slow to ask everywhere.
    year = r"(?=[12])(?<![A-Za-z0-9_])(1[0-9][0-9][0-9]|20[0-2][0-9])s?(?![A-Za-z0-9_])"
    return F.when(F.coalesce(c, F.lit("")).rlike(year), F.lit(0.5)).otherwise(F.lit(0.0))


def inflections(c: Column) -> Column:
    """A word with its plural and its d/ed, ing and ly forms, as an array."""
    stem = F.substring(c, F.lit(1), F.length(c) - 1)
    plural = (
        F.when(c.rlike("[^aeiou]y$"), F.concat(stem, F.lit("ies")))
        .when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )
    ends_e = c.endswith("e")
    past = F.when(ends_e, F.concat(c, F.lit("d"))).otherwise(F.concat(c, F.lit("ed")))
    gerund = F.when(ends_e, F.concat(stem, F.lit("ing"))).otherwise(F.concat(c, F.lit("ing")))
    return F.array_distinct(F.array(c, plural, past, gerund, F.concat(c, F.lit("ly"))))


def unwrap_excel(c: Column) -> Column:
    """What stands in ="..." or =...; a cell without the leading = stays as it is."""
    s = F.trim(F.coalesce(c, F.lit("")))
    form = r'^="?([^\n\r\u2028\u2029]*?)"?$'
    return F.trim(F.when(s.rlike(form), F.regexp_extract(s, form, 1)).otherwise(s))


def to_number(c: Column) -> Column:
    """Digits, dot and minus are kept; the longest numeric prefix counts, else null."""
    kept = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9.\-]", "")
    head = F.regexp_extract(kept, r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.nullif(head, F.lit("")).try_cast("double")


def clean_trailing(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\-–—:,]+$", ""))


def encode_component(c: Column) -> Column:
    """Percent-encoding as browsers do it for URL components."""
    e = F.url_encode(c)
    for coded, plain in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        e = F.replace(e, F.lit(coded), F.lit(plain))
    return e


def decode_component(c: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone; text that is not valid stays as it is."""
    guarded = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), c)
