"""Item features for cross-kind recommendations: axes, tone, scale, rare words, keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed
from ..functions.scores import item_score
from ..functions.text import base_title, inflections, norm_title
from ..session import materialise
from ..sources.catalogue import number_items
from .filters import eligible_target

AXES = fixed.AXES
BROADCAST_WORDS = 1_000_000  # profiles of about 150 bytes each
TASK_BYTES = 4 << 20  # most bytes of repeated texts whose words are brought together in a task, on average
DIGITS = 9  # sums arrive in any order; rounding makes equal items exactly equal


@dataclass
class Lexicon:
    """Word lists; the fixed ones by default, more words per list where a corpus needs them."""

    seeds: dict[str, str]
    warm: str = fixed.WARM
    grim: str = fixed.GRIM
    epic: str = fixed.EPIC
    small: str = fixed.SMALL

    @staticmethod
    def fixed(extra: dict[str, str] | None = None) -> "Lexicon":
        extra = extra or {}
        lists = {a: f"{fixed.SEEDS[a]} {extra.get(a, '')}" for a in AXES}
        poles = {p: f"{getattr(fixed, p.upper())} {extra.get(p, '')}" for p in ("warm", "grim", "epic", "small")}
        return Lexicon(lists, **poles)

    def rows(self) -> list[tuple[str, str]]:
        lists = {**self.seeds, "warm": self.warm, "grim": self.grim, "epic": self.epic, "small": self.small}
        return [(name, w) for name, text in lists.items() for w in text.split()]


def lexicon_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """word -> one 0/1 column per axis, plus `tone_hit` and `scale_hit` in -1..1."""
    seeds = spark.createDataFrame(lexicon.rows(), "list string, seed string")
    forms = seeds.select("list", F.explode(inflections(F.col("seed"))).alias("word")).distinct()
    has = lambda name: F.max(F.when(F.col("list") == name, 1).otherwise(0))
    return forms.groupBy("word").agg(
        *[has(a).alias(f"hit_{a}") for a in AXES],
        (has("warm") - has("grim")).alias("tone_hit"),
        (has("epic") - has("small")).alias("scale_hit"),
    )


def prior_table(spark: SparkSession) -> DataFrame:
    """genre -> axis weights, their unit vector, tone and scale; about fifty rows."""
    rows = []
    for genre, p in fixed.GENRE_PRIOR.items():
        g = [float(p.get(a, 0)) for a in AXES]
        length = math.sqrt(sum(x * x for x in g))
        unit = [x / length if length else 0.0 for x in g]
        rows.append((genre, *g, *unit, float(p.get("tone", 0)), float(p.get("scale", 0))))
    cols = ["genre string"]
    cols += [f"g_{a} double" for a in AXES] + [f"u_{a} double" for a in AXES]
    return spark.createDataFrame(rows, ", ".join([*cols, "prior_tone double", "prior_scale double"]))


def _count_words(drop: list[bytes]):
    """Texts in lower case, last of the columns -> the other columns, word, count: mapInArrow body.
    In UTF-8 no byte of another letter is in a-z, so runs are found in the bytes of a batch at once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            wide = "i8" if pa.types.is_large_binary(texts.type) else "i4"
            at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype("i8")
            if at[0] == at[-1]:
                continue
            data = np.frombuffer(texts.buffers()[2], "u1")[at[0] : at[-1]]
            at = at - at[0]
            letter = (data >= 97) & (data <= 122)
            apart = ~(letter[1:] & letter[:-1])
            inner = at[(at > 0) & (at < len(data))]
            apart[inner - 1] = True  # a text ends here
            start = np.flatnonzero(letter & np.append(True, apart))
            end = np.flatnonzero(letter & np.append(apart, True)) + 1
            short = end - start <= 2
            letter[start[short]] = letter[end[short] - 1] = False
            start, length = start[~short], (end - start)[~short]
            ends = np.append(0, np.cumsum(length)).astype("i4")
            runs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[letter])])
            coded = runs.dictionary_encode()
            n = max(1, len(coded.dictionary))
            used = ~pc.is_in(coded.dictionary, value_set=pa.array(drop, pa.binary())).to_numpy(zero_copy_only=False)
            row = np.searchsorted(at, start, side="right") - 1
            pair, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
            kept = used[pair % n]
            pair, tf = pair[kept], tf[kept]
            words = coded.dictionary.cast(pa.string())
            for a in range(0, len(pair), 65536):
                part = pair[a : a + 65536]
                columns = [c.take(pa.array(part // n)) for c in batch.columns[:-1]]
                columns += [words.take(pa.array(part % n)), pa.array(tf[a : a + 65536], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "word", "tf"])

    return run


def content_words(texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, word, tf): words of each text with their counts: ASCII runs over two letters, no stop words, no jargon.

    A task holds one batch of texts, however many it reads; no count is brought together across rows."""
    drop = sorted({w.encode() for w in (fixed.STOP + " " + fixed.JARGON).split()})
    lowered = texts.select(*keep, F.lower(F.coalesce("blurb", F.lit(""))).cast("binary").alias("_t"))
    schema = T.StructType([*lowered.drop("_t").schema, T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())])
    return lowered.mapInArrow(_count_words(drop), schema)


def word_counts(texts: DataFrame, meta: DataFrame) -> DataFrame:
    """(kind, pos, genre, copies, word, tf) over whole texts; `copies` is how many items of `meta` have that key.

    `texts` has kind, pos, genre, blurb, of the same items as `meta`. Words are counted where the texts are
    read, without an exchange; only keys that come more than once are brought together, in tasks that the
    bytes of their texts keep small, and not before."""
    key = ["kind", "pos"]
    found = texts.select(*key, "genre", "blurb").dropna(subset=key)
    repeated = materialise(meta.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    once = found if repeated.isEmpty() else found.join(repeated, key, "left_anti")
    counts = content_words(once.withColumn("copies", F.lit(1).cast("long")), [*key, "genre", "copies"])
    if repeated.isEmpty():
        return counts
    again = found.join(repeated, key)
    n = again.agg(F.sum(F.octet_length("blurb")).alias("n")).first()["n"] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_BYTES))
    many = content_words(again, [*key, "genre", "copies"]).repartition(tasks, *key, "word")
    return counts.unionByName(many.groupBy(*key, "genre", "copies", "word").agg(F.sum("tf").alias("tf")))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("copies").alias("df"))


def few(words_: DataFrame) -> DataFrame:
    """The same words, to be broadcast while they are few."""
    return F.broadcast(words_) if words_.count() <= BROADCAST_WORDS else words_


def corpus_baseline(items: DataFrame, priors: DataFrame) -> dict[str, float]:
    """Item count and mean prior vector, tone and scale; one row leaves Spark. Items whose
    genre has no prior count in the mean as zeros."""
    per_genre = items.groupBy("genre").agg(F.count("*").alias("n")).join(F.broadcast(priors), "genre", "left")
    mean = lambda c: (F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("n")) / F.sum("n"))
    row = per_genre.agg(
        F.sum("n").alias("n"),
        *[mean(f"u_{a}").alias(a) for a in AXES],
        mean("prior_tone").alias("tone"),
        mean("prior_scale").alias("scale"),
    ).first()
    return {k: (v if v is not None else 0) for k, v in row.asDict().items()}


def learn_profiles(counts: DataFrame, priors: DataFrame, base: dict[str, float]) -> DataFrame:
    """What a word says over and above base rates: word, df, l_<axis>, l_tone, l_scale.

    Sums per word are combined on the map side first, so a word that is in a third of all
    items costs a row per task, and sums are shuffled once. Words in under 3 items or in
    over 5% of them get no profile (nulls), but keep their df."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("copies"))
    sums = counts.select("word", "genre", "copies").join(F.broadcast(priors), "genre", "left").groupBy("word").agg(
        F.sum("copies").alias("df"),
        *[total(f"u_{a}").alias(f"s_{a}") for a in AXES],
        total("prior_tone").alias("s_tone"),
        total("prior_scale").alias("s_scale"),
    )
    known = (F.col("df") >= 3) & (F.col("df") <= base["n"] * 0.05)
    shrink = F.col("df") / (F.col("df") + fixed.SHRINK)
    learned = [
        F.when(known, (F.col(f"s_{a}") / F.col("df") - F.lit(float(base[a]))) * shrink).alias(f"l_{a}")
        for a in [*AXES, "tone", "scale"]
    ]
    return sums.select("word", "df", *learned)


def scarce_counts(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Counts of the words that no more items have than a rare word: most words, but few of all counts."""
    often = few(profiles.filter(F.col("df") > fixed.RARE_DF[1]).select("word"))
    return counts.join(often, "word", "left_anti")


def rare_words(counts: DataFrame, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """(word, columns of `items`): the rare words of each item; `items` has kind and pos.

    Most word counts are of words that many items have. Those words are few, so their counts
    are dropped before the others are brought together by word."""
    rare = profiles.filter(F.col("df").between(*fixed.RARE_DF)).select("word")
    found = scarce_counts(counts.select("kind", "pos", "word"), profiles).join(rare, "word")
    return found.join(items, ["kind", "pos"])


def item_meta(narrow: DataFrame) -> DataFrame:
    """Numbers, keys, score and eligibility per item, from the catalogue without its texts. Keys are
    made where the catalogue is read; the few tasks that number its items only carry them."""
    keyed = narrow.withColumn("score", item_score()).select(
        "kind", "pos", "genre",
        norm_title(F.col("title")).alias("title_key"),
        base_title(F.col("title")).alias("base_key"),
        norm_title(F.coalesce("author", "creator")).alias("maker"),
        "score",
        eligible_target(fixed.MIN_QUALITY, fixed.MIN_RATINGS).alias("eligible"),
        "period",
    )
    return number_items(keyed).select(
        "kind", "pos", "kind_rank", "gid", "turn", "genre", "title_key", "base_key", "maker", "score", "eligible", "period"
    )


def learned_sums(
    words_: DataFrame, profiles: DataFrame, item: list[str], most: int = BROADCAST_WORDS, lexicon: DataFrame | None = None,
    scarce: DataFrame | None = None,
) -> DataFrame:
    """Sums of what an item's words say, over all words with a profile; at most `most` profiles are broadcast.
    With `lexicon` also the sums of its columns over the words it has, in the same pass. `scarce` has the rows
    of `words_` whose words are scarce, where they are at hand."""
    names = [f"l_{a}" for a in [*AXES, "tone", "scale"]]
    hits = [c for c in lexicon.columns if c != "word"] if lexicon is not None else []
    add = lambda rows, weight: rows.groupBy(*item).agg(*[F.sum(F.col(c) * weight).alias(c) for c in [*names, *hits]])

    def said(profiled: DataFrame) -> DataFrame:
        if lexicon is None:
            return words_.join(F.broadcast(profiled), "word")
        both = words_.join(F.broadcast(profiled), "word", "left").join(F.broadcast(lexicon), "word", "left")
        return both.filter(F.col("l_tone").isNotNull() | F.col(hits[0]).isNotNull())

    learned = profiles.filter(F.col("l_tone").isNotNull())
    n = learned.count()
    if n <= most:
        return add(said(learned.drop("df")), F.col("tf"))
    cut = learned.agg(F.percentile_approx("df", 1 - most / n, 100_000).alias("cut")).first()["cut"]
    often = few(profiles.filter(F.col("df") > cut).select("word"))
    top, rest = (learned.filter(c).drop("df") for c in (F.col("df") > cut, F.col("df") <= cut))
    near = add(said(top), F.col("tf"))
    beyond = words_ if scarce is None or cut > fixed.RARE_DF[1] else scarce
    far = beyond.join(often, "word", "left_anti").join(rest, "word")
    far = add(far.withColumns({c: F.lit(None).cast(lexicon.schema[c].dataType) for c in hits}) if hits else far, F.col("tf"))
    return add(near.unionByName(far), F.lit(1))


def raw_parts(
    meta: DataFrame, counts: DataFrame, profiles: DataFrame, lexicon: DataFrame, priors: DataFrame, scarce: DataFrame | None = None
) -> DataFrame:
    """Per item: genre vector g_, lexicon hits b_, learned sums l_, tone and scale parts.

    Lexicon hits come from a broadcast of fixed size, and so do the profiles of the most
    frequent words, which make up nearly all counts, so that both sums are nearly complete
    within a task that reads the counts once. Only counts of the words beyond are joined by
    word; none of them is a hot key."""
    item = ["kind", "pos"]
    of = lambda rows: rows.select(*item, "word", (F.col("tf") * F.col("copies")).alias("tf"))
    named = {f"hit_{a}": f"b_{a}" for a in AXES} | {"tone_hit": "tone_hits", "scale_hit": "scale_hits"}
    scarce = of(scarce) if scarce is not None else None
    sums = learned_sums(of(counts), profiles, item, lexicon=lexicon.withColumnsRenamed(named), scarce=scarce)
    joined = meta.join(sums, item, "left").join(F.broadcast(priors), "genre", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    b = {a: zero(f"b_{a}") for a in AXES}
    b["history"] = b["history"] + F.col("period")
    return joined.select(
        "gid", "kind", "pos", "kind_rank", "turn", "genre", "title_key", "base_key", "maker", "score",
        "eligible",
        *[zero(f"g_{a}").alias(f"g_{a}") for a in AXES],
        *[b[a].alias(f"b_{a}") for a in AXES],
        *[zero(f"l_{a}").alias(f"l_{a}") for a in AXES],
        *[zero(c).alias(c) for c in ("tone_hits", "scale_hits", "l_tone", "l_scale", "prior_tone", "prior_scale")],
    )


def axis_hits(parts: DataFrame) -> DataFrame:
    """Items in which an axis fires from genre or blurb, and the item count; one row."""
    fires = lambda a: F.count_if((F.col(f"g_{a}") > 0) | (F.col(f"b_{a}") > 0))
    return parts.agg(F.count("*").alias("n"), *[fires(a).alias(a) for a in AXES])


def axis_idf(parts: DataFrame) -> dict[str, float]:
    row = axis_hits(parts).first()
    return {a: math.log(row["n"] / max(1, row[a])) / math.log(20) if row["n"] else 1.0 for a in AXES}


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def facets(parts: DataFrame, idf: dict[str, float]) -> DataFrame:
    """Unit vector v_<axis>, tone and scale per item; scalar columns stay inside codegen."""
    raw = parts.select(
        "gid", "kind", "pos", "kind_rank", "turn", "title_key", "base_key", "maker", "score", "eligible",
        *[
            (
                F.greatest(
                    F.lit(0.0),
                    F.lit(fixed.GENRE_W) * F.sqrt(f"g_{a}")
                    + F.lit(fixed.BLURB_W) * F.sqrt(f"b_{a}")
                    + F.lit(fixed.LEARN_W) * F.col(f"l_{a}"),
                )
                * F.lit(idf[a])
            ).alias(f"r_{a}")
            for a in AXES
        ],
        F.round(
            _clamp(F.col("prior_tone") + F.col("tone_hits") * fixed.TONE_HIT_W + F.lit(fixed.TONE_LEARN_W) * F.col("l_tone")),
            DIGITS,
        ).alias("tone"),
        F.round(
            _clamp(F.col("prior_scale") + F.col("scale_hits") * fixed.SCALE_HIT_W + F.lit(fixed.TONE_LEARN_W) * F.col("l_scale")),
            DIGITS,
        ).alias("scale"),
    )
    squares = F.lit(0.0)
    for a in AXES:
        squares = squares + F.col(f"r_{a}") * F.col(f"r_{a}")
    unit = raw.withColumn("_len", F.sqrt(squares))
    return unit.select(
        "gid", "kind", "pos", "kind_rank", "turn", "title_key", "base_key", "maker", "score", "eligible", "tone", "scale",
        *[
            F.round(F.when(F.col("_len") > 0, F.col(f"r_{a}") / F.col("_len")).otherwise(F.lit(0.0)), DIGITS).alias(f"v_{a}")
            for a in AXES
        ],
    )


@dataclass
class Features:
    """Materialised inputs of pair scoring."""

    ids: DataFrame
    counts: DataFrame
    profiles: DataFrame
    parts: DataFrame
    vectors: DataFrame
    idf: dict[str, float]
    scarce: DataFrame | None = None  # counts of scarce words, where more words have a profile than are broadcast


def build_features(texts: DataFrame, narrow: DataFrame, lexicon: Lexicon | None = None) -> Features:
    """`texts` has kind, pos, genre, blurb; `narrow` is the catalogue without texts. Each stage that
    several later ones read is written once."""
    spark = texts.sparkSession
    meta = materialise(item_meta(narrow), "meta")
    counts = materialise(word_counts(texts, meta), "words")
    priors = prior_table(spark)
    base = corpus_baseline(meta.select("genre"), priors)
    profiles = materialise(learn_profiles(counts, priors, base), "profiles")
    lex = lexicon_table(spark, lexicon or Lexicon.fixed())
    scarce = None
    if profiles.filter(F.col("l_tone").isNotNull()).count() > BROADCAST_WORDS:
        scarce = materialise(scarce_counts(counts, profiles), "scarce")  # for the sums and for rare words
    parts = materialise(raw_parts(meta, counts, profiles, lex, priors, scarce), "parts")
    idf = axis_idf(parts)
    vectors = materialise(facets(parts, idf), "vectors")
    return Features(meta.select("kind", "pos", "kind_rank", "gid", "turn"), counts, profiles, parts, vectors, idf, scarce)
