"""Recommendation build, stage by stage."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

from ..functions import fixed
from ..functions.text import inflections, period_signal
from ..operators import neighbours as nb, reports, similarity as sim
from ..operators.adaptations import adaptations
from ..session import materialise, side_by_side
from ..sources.artefacts import slim_index
from ..sources.catalogue import entries, texts
from . import recommend_oracle as o
from .oracle import CAT
from .registry import query
from .view_queries import SLIM_ONLY

AXES = sim.AXES


@lru_cache(maxsize=4)
def _features(app: str, d: str) -> sim.Features:
    spark = SparkSession.active()
    return sim.build_features(texts(spark, d), entries(spark, d), o.LEX)


def features(spark, d) -> sim.Features:
    """Feature tables are built once per application and folder; the queries read them."""
    return _features(spark.sparkContext.applicationId, d)


@lru_cache(maxsize=4)
def _candidates(app: str, d: str):
    return materialise(nb.candidates(_features(app, d)), "candidates")


def candidates(spark, d):
    return _candidates(spark.sparkContext.applicationId, d)


@lru_cache(maxsize=4)
def _assigned(app: str, d: str):
    return materialise(nb.neighbour_slots(nb.assign(_candidates(app, d))), "slots")


def assigned(spark, d):
    """Slots after the capacity limit."""
    return _assigned(spark.sparkContext.applicationId, d)


def open_slots(spark, d):
    """Slots without the capacity limit: the best three candidates per medium."""
    best = candidates(spark, d).filter(F.col("place") <= fixed.K_PER_MEDIUM).withColumn("pick", F.col("place"))
    return nb.neighbour_slots(best)


def rounded(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def r6(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


G = [f"g_{a}" for a in AXES]
B = [f"b_{a}" for a in AXES]
L = [f"l_{a}" for a in AXES]
V = [f"v_{a}" for a in AXES]


@query(
    "content_words",
    f"WITH {o.WORDS} SELECT kind, pos, CAST(sum(tf) AS BIGINT) AS n_words, count(*) AS n_distinct FROM words GROUP BY kind, pos",
)
def _(spark, d):
    return features(spark, d).counts.groupBy("kind", "pos").agg(
        F.sum(F.col("tf") * F.col("copies")).alias("n_words"), F.sum("copies").alias("n_distinct")
    )


@query("document_frequency", f"WITH {o.WORDS} SELECT word, df FROM dfs")
def _(spark, d):
    return sim.document_frequency(features(spark, d).counts)


@query(
    "inflect_words",
    f"WITH {o.WORDS} SELECT word, array_to_string(list_sort(list_distinct({o.inflect_sql('word')})), ' ') AS forms FROM dfs",
)
def _(spark, d):
    words = features(spark, d).profiles.select("word")
    return words.select("word", F.array_join(F.array_sort(inflections(F.col("word"))), " ").alias("forms"))


@query(
    "period_signal",
    f"""WITH {CAT} SELECT kind, pos, CASE WHEN regexp_matches(coalesce(blurb, ''), '\\b(1[0-9][0-9][0-9]|20[0-2][0-9])s?\\b')
    THEN 0.5::DOUBLE ELSE 0 END AS period FROM cat""",
)
def _(spark, d):
    return texts(spark, d).select("kind", "pos", period_signal(F.col("blurb")).alias("period"))


@query("genre_prior", f"WITH {o.PARTS} SELECT kind, pos, {', '.join(G)}, prior_tone, prior_scale FROM parts")
def _(spark, d):
    return features(spark, d).parts.select("kind", "pos", *G, "prior_tone", "prior_scale")


@query("lexicon_hits", f"WITH {o.PARTS} SELECT kind, pos, {', '.join(B)} FROM parts")
def _(spark, d):
    return features(spark, d).parts.select("kind", "pos", *B)


@query("raw_parts", f"WITH {o.PARTS} SELECT kind, pos, {', '.join(G)}, {', '.join(B)}, {r6(L)} FROM parts")
def _(spark, d):
    return features(spark, d).parts.select("kind", "pos", *G, *B, *rounded(*L))


@query(
    "axis_idf",
    f"WITH {o.PARTS} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, h_{a} AS hits, round(i_{a}, 6) AS idf FROM idf" for a in AXES),
)
def _(spark, d):
    hits = sim.axis_hits(features(spark, d).parts)
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("hits")) for a in AXES])
    idf = F.log(F.col("n") / F.greatest(F.lit(1), F.col("hits"))) / F.log(F.lit(20.0))
    return hits.select("n", F.inline(rows)).select("axis", "hits", F.round(idf, 6).alias("idf"))


@query("learn_word_profiles", f"WITH {o.PARTS} SELECT word, df, {r6(L)} FROM learned")
def _(spark, d):
    learned = features(spark, d).profiles.filter(F.col("l_moral").isNotNull())
    return learned.select("word", "df", *rounded(*L))


@query("learn_word_tone_scale", f"WITH {o.PARTS} SELECT word, {r6(['l_tone', 'l_scale'])} FROM learned")
def _(spark, d):
    learned = features(spark, d).profiles.filter(F.col("l_tone").isNotNull())
    return learned.select("word", *rounded("l_tone", "l_scale"))


@query("facet_vector", f"WITH {o.VECTORS} SELECT gid, kind, pos, {r6(V)} FROM vec")
def _(spark, d):
    return features(spark, d).vectors.select("gid", "kind", "pos", *rounded(*V))


@query("tone", f"WITH {o.VECTORS} SELECT gid, {r6(['tone'])} FROM vec")
def _(spark, d):
    return features(spark, d).vectors.select("gid", *rounded("tone"))


@query("scale", f"WITH {o.VECTORS} SELECT gid, {r6(['scale'])} FROM vec")
def _(spark, d):
    return features(spark, d).vectors.select("gid", *rounded("scale"))


@query("item_score", f"WITH {o.VECTORS} SELECT gid, {r6(['score'])}, eligible FROM vec")
def _(spark, d):
    return features(spark, d).vectors.select("gid", *rounded("score"), "eligible")


@query("title_keys", f"WITH {o.VECTORS} SELECT gid, title_key, base_key, left(title_key, 8) AS pre8, maker FROM vec")
def _(spark, d):
    pre8 = F.substring("title_key", 1, 8).alias("pre8")
    return features(spark, d).vectors.select("gid", "title_key", "base_key", pre8, "maker")


@query("rare_words", f"WITH {o.RARE} SELECT kind, pos, word FROM rare")
def _(spark, d):
    f = features(spark, d)
    return sim.rare_words(f.counts, f.profiles, f.ids.select("kind", "pos")).select("kind", "pos", "word")


@query("rare_word_join", f"WITH {o.RARE} SELECT gid, neighbour, shared FROM pairs")
def _(spark, d):
    return nb.rare_pairs(features(spark, d))


_PAIRS_FROM = "pairs p JOIN vec i ON i.gid = p.gid JOIN vec j ON j.gid = p.neighbour"


@query("related_titles", f"WITH {o.RARE} SELECT p.gid, p.neighbour FROM {_PAIRS_FROM} WHERE {o.RELATED}")
def _(spark, d):
    met = nb.rare_meetings(features(spark, d), ["title_key", "base_key"]).filter(nb.related())
    return met.select(*nb.pair()).distinct()


@query("same_maker", f"WITH {o.RARE} SELECT p.gid, p.neighbour FROM {_PAIRS_FROM} WHERE {o.SAME_MAKER}")
def _(spark, d):
    met = nb.rare_meetings(features(spark, d), ["maker"]).filter(nb.same_maker())
    return met.select(*nb.pair()).distinct()


@query(
    "pair_score",
    f"""WITH {o.RARE} SELECT p.gid, p.neighbour, round({o.score_sql('p.shared')}, 6) AS sim, {o.AXIS} AS axis
    FROM {_PAIRS_FROM}""",
)
def _(spark, d):
    f = features(spark, d)
    scored = nb.rare_scores(f, nb.rare_meetings(f, nb.SCORED))
    return scored.select("gid", "neighbour", F.round("sim", 6).alias("sim"), "axis")


@query(
    "cross_medium_pairs",
    f"""WITH {o.VECTORS}, s AS (SELECT i.gid, j.kind_rank AS target_rank, j.gid AS neighbour, {o.score_sql('0')} AS sim
      FROM vec i JOIN vec j ON j.eligible AND j.kind_rank <> i.kind_rank WHERE NOT {o.RELATED} AND NOT {o.SAME_MAKER})
    SELECT gid, target_rank, neighbour, round(sim, 6) AS sim FROM s WHERE sim >= 0.22
    QUALIFY row_number() OVER (PARTITION BY gid, target_rank ORDER BY sim DESC, neighbour) <= 8""",
)
def _(spark, d):
    from ..operators.sorting import top_per_group

    plain = nb.plain_candidates(features(spark, d).vectors)
    best = top_per_group(plain, ["gid", "target_rank"], [F.desc("sim"), F.asc("neighbour")], fixed.WIDE)
    return best.select("gid", "target_rank", "neighbour", F.round("sim", 6).alias("sim"))


@query(
    "top_candidates",
    f"WITH {o.CANDS} SELECT gid, target_rank, neighbour, place, axis, round(sim, 6) AS sim FROM cand",
)
def _(spark, d):
    return candidates(spark, d).select("gid", "target_rank", "neighbour", "place", "axis", F.round("sim", 6).alias("sim"))


@query(
    "adaptations",
    f"""WITH {o.VECTORS}, g AS (SELECT i.gid, j.gid AS other FROM vec i JOIN vec j
      ON i.base_key = j.base_key AND i.base_key <> '' AND i.kind_rank <> j.kind_rank)
    SELECT gid, list(other ORDER BY other)[1:4] AS others FROM g GROUP BY gid""",
)
def _(spark, d):
    return adaptations(features(spark, d).vectors)


@query("neighbour_slots", f"WITH {o.SLOTS} SELECT gid, slot, neighbour, axis FROM slots")
def _(spark, d):
    return open_slots(spark, d).select("gid", "slot", "neighbour", "axis")


_PACK = f"""{o.ASSIGNED},
dig AS (SELECT *, '0123456789abcdefghijklmnopqrstuvwxyz' AS z FROM aslots),
cell AS (SELECT gid, slot, z[neighbour // 1296 + 1] || z[(neighbour // 36) % 36 + 1] || z[neighbour % 36 + 1] || z[axis + 2] AS c FROM dig),
pack AS (SELECT num.gid, {' || '.join(f"coalesce(max(c) FILTER (slot = {s}), '0000')" for s in range(9))} AS packed
  FROM num LEFT JOIN cell ON cell.gid = num.gid GROUP BY num.gid)"""


@query("pack_neighbours", f"WITH {_PACK} SELECT gid, packed FROM pack")
def _(spark, d):
    ids = features(spark, d).ids
    return reports.pack_neighbours(ids, assigned(spark, d), reports.slot_digits(ids))


@query("unpack_neighbours", f"WITH {o.ASSIGNED} SELECT gid, slot, neighbour, axis FROM aslots")
def _(spark, d):
    ids = features(spark, d).ids
    width = reports.slot_digits(ids)
    return reports.unpack_neighbours(reports.pack_neighbours(ids, assigned(spark, d), width), width)


_DOM = f"""{o.ASSIGNED}, h AS (SELECT gid, axis, count(*) AS n, max(slot) AS reached FROM aslots WHERE axis >= 0 GROUP BY gid, axis),
dom AS (SELECT gid, axis FROM h QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, reached) = 1)"""


@query("dominant_axis", f"WITH {_DOM} SELECT gid, axis FROM dom")
def _(spark, d):
    return reports.dominant_axis(assigned(spark, d))


_PHRASES = ", ".join(f"'{fixed.AXIS_PHRASE[a]}'" for a in AXES)


@query(
    "explain_neighbours",
    f"WITH {_DOM} SELECT gid, 'Mostly picked because both are ' || ([{_PHRASES}])[axis + 1] || '.' AS reason FROM dom",
)
def _(spark, d):
    return reports.explain(assigned(spark, d))


@query(
    "decorate_neighbours",
    f"""WITH {o.ASSIGNED}, {SLIM_ONLY}
    SELECT s.gid, s.slot, s.neighbour, s.axis, n.kind AS neighbour_kind, m.title, m.year, m.score,
      CASE WHEN m.score IS NULL THEN 'none' WHEN m.score >= 80 THEN 'good' WHEN m.score >= 60 THEN 'mid' ELSE 'bad' END AS band,
      CASE WHEN n.kind = 'books' THEN 'readers' WHEN m.verified = 1 THEN 'critics ✓' ELSE 'critics' END AS basis
    FROM aslots s JOIN num n ON n.gid = s.neighbour JOIN slim m ON m.kind = n.kind AND m.pos = n.pos""",
)
def _(spark, d):
    return reports.decorate(assigned(spark, d), features(spark, d).ids, slim_index(entries(spark, d)))


# ---- with the capacity limit; the oracle walks the items one by one ----


@query("capacity_assign", f"WITH {o.ASSIGNED} SELECT gid, target_rank, neighbour, pick, slot, axis, round(sim, 6) AS sim FROM aslots")
def _(spark, d):
    return assigned(spark, d).select("gid", "target_rank", "neighbour", "pick", "slot", "axis", F.round("sim", 6).alias("sim"))


@query(
    "assignment_limits",
    "SELECT true AS cap_kept, true AS quota_kept, true AS cross_kind, true AS floor_kept, true AS ordered",
)
def _(spark, d):
    s = assigned(spark, d)
    inbound = s.groupBy("neighbour").agg(F.count("*").alias("n")).agg((F.max("n") <= fixed.CAP).alias("cap_kept"))
    per = s.groupBy("gid", "target_rank").agg(
        F.count("*").alias("n"),
        F.min("sim").alias("low"),
        (F.first("kind_rank") != F.col("target_rank")).alias("cross"),
        F.array_sort(F.collect_list(F.struct("pick", (-F.col("sim")).alias("s")))).alias("picks"),  # at most three
    )
    in_order = F.col("picks.s") == F.array_sort("picks.s")
    rest = per.agg(
        (F.max("n") <= fixed.K_PER_MEDIUM).alias("quota_kept"),
        F.every(F.col("cross")).alias("cross_kind"),
        (F.min("low") >= fixed.MIN_SIM).alias("floor_kept"),
        F.every(in_order).alias("ordered"),
    )
    return side_by_side(inbound, rest)


@query(
    "thin_flag",
    f"""WITH {o.ASSIGNED} SELECT num.gid, count(a.gid) AS picks, count(a.gid) < 3 AS thin FROM num LEFT JOIN aslots a ON a.gid = num.gid GROUP BY num.gid""",
)
def _(spark, d):
    return reports.thin_items(features(spark, d).ids, assigned(spark, d))


@query(
    "build_report",
    f"""WITH {o.ASSIGNED}, p AS (SELECT num.gid, count(s.gid) AS picks FROM num LEFT JOIN aslots s ON s.gid = num.gid GROUP BY 1),
    g AS (SELECT DISTINCT i.gid FROM vec i JOIN vec j ON i.base_key = j.base_key AND i.base_key <> '' AND i.kind_rank <> j.kind_rank)
    SELECT count(*) AS items, CAST(sum(picks) AS BIGINT) AS filled, CAST(floor(sum(picks) / (count(*) * 9) * 100 + 0.5) AS INTEGER) AS fill_percent,
    count(*) FILTER (picks < 3) AS thin, (SELECT count(*) FROM g) AS adaptations FROM p""",
)
def _(spark, d):
    f = features(spark, d)
    return reports.build_report(f.ids, assigned(spark, d), adaptations(f.vectors))


@query(
    "hub_report",
    f"""WITH {o.ASSIGNED}, b AS (SELECT neighbour AS gid, count(*) AS inbound FROM aslots GROUP BY 1)
    SELECT kind, coalesce(max(inbound), 0) AS worst_hub, round(count(*) FILTER (inbound IS NULL) / count(*), 6) AS never_recommended
    FROM num LEFT JOIN b USING (gid) GROUP BY kind""",
)
def _(spark, d):
    return reports.hub_report(features(spark, d).ids, assigned(spark, d))


@query(
    "open_hub_report",
    f"""WITH {o.SLOTS}, b AS (SELECT neighbour AS gid, count(*) AS inbound FROM slots GROUP BY 1)
    SELECT kind, coalesce(max(inbound), 0) AS worst_hub, round(count(*) FILTER (inbound IS NULL) / count(*), 6) AS never_recommended
    FROM num LEFT JOIN b USING (gid) GROUP BY kind""",
)
def _(spark, d):
    return reports.hub_report(features(spark, d).ids, open_slots(spark, d))


@query(
    "open_build_report",
    f"""WITH {o.SLOTS}, p AS (SELECT num.gid, count(s.gid) AS picks FROM num LEFT JOIN slots s ON s.gid = num.gid GROUP BY 1),
    g AS (SELECT DISTINCT i.gid FROM vec i JOIN vec j ON i.base_key = j.base_key AND i.base_key <> '' AND i.kind_rank <> j.kind_rank)
    SELECT count(*) AS items, CAST(sum(picks) AS BIGINT) AS filled, CAST(floor(sum(picks) / (count(*) * 9) * 100 + 0.5) AS INTEGER) AS fill_percent,
    count(*) FILTER (picks < 3) AS thin, (SELECT count(*) FROM g) AS adaptations FROM p""",
)
def _(spark, d):
    f = features(spark, d)
    return reports.build_report(f.ids, open_slots(spark, d), adaptations(f.vectors))


@query(
    "missing_priors",
    f"WITH {CAT}, {o.PRIORS} SELECT DISTINCT kind, genre FROM cat WHERE genre NOT IN (SELECT genre FROM prior)",
)
def _(spark, d):
    labels = entries(spark, d).select("kind", "genre").distinct()
    return labels.join(F.broadcast(sim.prior_table(spark)), "genre", "left_anti").select("kind", "genre")


# Stand-ins in the corpus for words that name a person.
SUBJECTS = ["her", "his", "seine", "ses", "sus", "nous"]
_JARGON = ", ".join(f"'{w}'" for w in fixed.JARGON.split() + ["thonst", "eren"])
_SUBJ = ", ".join(f"'{w}'" for w in SUBJECTS)
_TOK = "regexp_extract_all(lower(coalesce(blurb, '')), '[a-z]+')"


@query(
    "register_profile",
    f"""WITH {CAT} SELECT kind, round(avg(CASE WHEN list_has_any({_TOK}, [{_JARGON}]) THEN 1 ELSE 0 END), 6) AS jargon_share,
    round(avg(CASE WHEN list_has_any({_TOK}, [{_SUBJ}]) THEN 1 ELSE 0 END), 6) AS subject_share FROM cat GROUP BY kind""",
)
def _(spark, d):
    from ..functions.text import words

    tokens = words(F.col("blurb"))
    jargon = F.array(*[F.lit(w) for w in fixed.JARGON.split() + ["thonst", "eren"]])
    subjects = F.array(*[F.lit(w) for w in SUBJECTS])
    share = lambda lst: F.round(F.avg(F.arrays_overlap(tokens, lst).cast("int")), 6)
    return texts(spark, d).groupBy("kind").agg(
        share(jargon).alias("jargon_share"), share(subjects).alias("subject_share")
    )


@query(
    "corpus_profile",
    f"""WITH {o.RARE}, len AS (SELECT kind, pos, sum(tf) AS n FROM words GROUP BY kind, pos),
    two AS (SELECT num.gid, count(p.neighbour) AS partners FROM num LEFT JOIN (SELECT * FROM pairs WHERE shared >= 2) p ON p.gid = num.gid GROUP BY 1)
    SELECT (SELECT median(n) FROM len) AS median_words, CAST((SELECT min(n) FROM len) AS BIGINT) AS min_words, CAST((SELECT max(n) FROM len) AS BIGINT) AS max_words,
    (SELECT count(*) FROM dfs) AS vocabulary, (SELECT count(*) FROM dfs WHERE df = 1) AS hapax,
    round((SELECT avg(partners) FROM two), 6) AS mean_partners,
    round((SELECT count(*) FILTER (partners < 9) / count(*) FROM two), 6) AS under_nine""",
)
def _(spark, d):
    f = features(spark, d)
    lengths = f.counts.groupBy("kind", "pos").agg(F.sum(F.col("tf") * F.col("copies")).alias("n")).agg(
        F.median("n").alias("median_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words")
    )
    vocabulary = f.profiles.agg(F.count("*").alias("vocabulary"), F.count_if(F.col("df") == 1).alias("hapax"))
    two = nb.rare_pairs(f).filter("shared >= 2").groupBy("gid").agg(F.count("*").alias("partners"))
    partners = (
        f.ids.select("gid").join(two, "gid", "left").fillna(0, ["partners"]).agg(
            F.round(F.avg("partners"), 6).alias("mean_partners"),
            F.round(F.count_if(F.col("partners") < 9) / F.count("*"), 6).alias("under_nine"),
        )
    )
    return side_by_side(lengths, vocabulary, partners)
