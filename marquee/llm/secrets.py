"""Secret scan: candidates by form, false positives removed by a random forest. Column expressions and Spark ML only.

Candidates are runs of at least MIN_LENGTH characters of keys and hashes with a digit among them, found word by word with the
words around them. A forest over length, kinds of characters and the transitions between them, coverage by
dictionary words, path and neighbouring words decides which are secrets. The dictionary is the corpus's DICTIONARY
most frequent words of four to eight letters, counted over all texts.

The forest learns from labelled findings: a frame of candidates with a column `label`. Where no reviewed
findings exist, label_findings() labels candidates whose origin is plain: an issuer's format or an
assignment to a secret's name is a secret, digits alone, paths, addresses and placeholders are not, and all others stay
unlabelled. It learns on TRAIN_ROWS labelled rows with the smallest hashes and is applied to all candidates.

Defined results: a row per candidate; null and empty texts have none; null ids and paths are kept; repeated documents give repeated
rows; ties between equal values fall by position; further columns are left out; without labelled
findings of both kinds the labels decide and unlabelled candidates are no secrets; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

MIN_LENGTH = 12
DICTIONARY = 1000
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 8
BAR = 0.5

#: Names that secrets are assigned to, words near placeholders, parts of paths.
SECRET_NAMES = "password|passwd|pwd|token|secret|api_?key|apikey|access_?key|private_?key|auth|bearer|credential"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|xxxx|test"
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35})$"
TEST_PATHS = "test|spec|example|sample|doc|fixture|mock"
CONFIG_PATHS = r"\.(env|ya?ml|json|ini|conf|cfg|toml|properties|tfvars)$|config|secret|credential"

_VALUE = rf"([A-Za-z0-9_+/\-]{{{MIN_LENGTH},}})"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, path, word_at (from 0), word, value, before (the word and the two before it up to the value), after."""
    words = F.split(F.col(text_col), r"\s+")

    def found(ws):
        def is_candidate(i):
            w = F.element_at(ws, i)
            return (F.length(w) >= MIN_LENGTH) & (F.translate(w, "0123456789", "") != w) & w.rlike(_VALUE)

        def around(i):
            at = lambda k: F.when((k >= 1) & (k <= F.size(ws)), F.element_at(ws, F.greatest(F.least(k, F.size(ws)), F.lit(1)))).otherwise(F.lit(""))
            return F.struct((i - 1).alias("word_at"), F.element_at(ws, i).alias("word"), at(i - 2).alias("w2"), at(i - 1).alias("w1"), at(i + 1).alias("after"))

        return F.transform(F.filter(F.sequence(F.lit(1), F.size(ws)), is_candidate), around)

    # The words are bound to a variable, so a text is split once.
    hits = F.element_at(F.transform(F.array(words), found), 1)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.filter(F.length(text_col) >= MIN_LENGTH).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.explode(hits).alias("c"))
    each = rows.select("doc_id", "path", "c.*")
    # A word can hold several runs; what stands before a run in its word may name it.
    runs = F.filter(F.regexp_extract_all("word", F.lit(_VALUE), F.lit(1)), lambda v: v.rlike("[0-9]"))
    each = each.withColumn("value", F.explode(F.array_distinct(runs)))
    head = F.expr("substring_index(word, value, 1)")
    return each.select("doc_id", "path", "word_at", "word", "value", F.concat_ws(" ", "w2", "w1", head).alias("before"), "after")


def common_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The most frequent words of four to eight letters, at most `most`; equal counts in alphabetical order."""
    words = docs.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("w")).filter(F.length("w").between(4, 8))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def share(pattern: str, length: Column) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / length


def with_features(found: DataFrame, dictionary: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the forest's inputs; names their columns."""
    n = F.length("value").cast("double")
    low, before, near = F.lower("value"), F.lower("before"), F.lower(F.concat_ws(" ", "before", "after"))
    path = F.lower("path")
    flag = lambda c: c.cast("double")
    covered = F.length(F.regexp_replace(low, "|".join(dictionary), "")) if dictionary else n
    made = {
        "length": n,
        "digits": share("[0-9]", n),
        "capitals": share("[A-Z]", n),
        "smalls": share("[a-z]", n),
        "hex": share("[0-9a-f]", n),
        "others": share("[^0-9A-Za-z]", n),
        "letter_digit": share("[A-Za-z](?=[0-9])", n),
        "digit_letter": share("[0-9](?=[A-Za-z])", n),
        "small_capital": share("[a-z](?=[A-Z])", n),
        "capital_small": share("[A-Z](?=[a-z])", n),
        "digit_digit": share("[0-9](?=[0-9])", n),
        "letter_letter": share("[A-Za-z](?=[A-Za-z])", n),
        "vowel_consonant": share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])", n),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "dictionary": 1 - covered / n,
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_test": flag(path.rlike(TEST_PATHS)),
        "path_config": flag(path.rlike(CONFIG_PATHS)),
        "named": flag(before.rlike(SECRET_NAMES)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$")),
        "placeholder": flag(near.rlike(PLACEHOLDERS) | low.rlike(PLACEHOLDERS)),
        "address": flag(F.col("word").rlike("@|://|^www")),
    }
    return found.withColumns(made), list(made)


def label_findings(found: DataFrame) -> DataFrame:
    """Candidates whose origin is plain, with label 1 or 0."""
    before, low = F.lower("before"), F.lower("value")
    placeholder = low.rlike(PLACEHOLDERS)
    secret = (F.col("value").rlike(ISSUED) | (before.rlike(rf"({SECRET_NAMES})\S{{0,20}}\s*[=:]\s*[\"']?$"))) & ~placeholder
    other = F.col("value").rlike(r"^[0-9+\-]+$") | F.col("word").rlike("@|://|^www|^/") | placeholder
    return found.withColumn("label", F.when(secret, 1.0).when(other, 0.0)).filter("label is not null")


def scan(docs: DataFrame, findings: DataFrame | None = None, bar: float = BAR, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, word_at, value, probability, is_secret of every candidate.

    `findings` are labelled candidates (columns of candidates() and label); by default those of the
    documents themselves whose origin is plain.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    dictionary = common_words(docs, text_col)
    found, inputs = with_features(candidates(docs, id_col, text_col, path_col), dictionary)
    found = materialise(found, "candidates")
    known = label_findings(found) if findings is None else with_features(findings, dictionary)[0]
    total = known.count()
    part = min(1.0, 1.25 * TRAIN_ROWS / max(total, 1))
    h = F.xxhash64("value", "before", "after")
    # Copies of one finding are one example, so a hot value cannot fill the sample.
    sample = known.select(*inputs, "label", h.alias("h")).filter(F.shiftrightunsigned("h", 1) <= min(int(part * 2**62) * 2, 2**63 - 1))
    sample = sample.dropDuplicates(["h", "label"]).orderBy("h", "label").limit(TRAIN_ROWS)
    sample = materialise(sample.coalesce(1), "findings")
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        own = label_findings(found).select("doc_id", "word_at", "value", F.col("label").alias("probability"))
        rest = found.join(own.select("doc_id", "word_at").distinct(), ["doc_id", "word_at"], "left_anti").select("doc_id", "word_at", "value", F.lit(0.0).alias("probability"))
        return own.unionByName(rest).withColumn("is_secret", F.col("probability") >= bar)
    assemble = VectorAssembler(inputCols=inputs, outputCol="x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11)
    model = forest.fit(assemble.transform(sample))
    judged = model.transform(assemble.transform(found))
    p = F.element_at(vector_to_array("probability"), 2)
    return judged.select("doc_id", "word_at", "value", F.round(p, 9).alias("probability")).withColumn("is_secret", F.col("probability") >= bar)


def redact(docs: DataFrame, secrets: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret's value replaced in the text; secrets are rows of scan(), with their ids under the name of those of docs. Longer values go first."""
    values = secrets.filter(F.col("is_secret") & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_set("value").alias("_values"))
    by_length = F.transform(F.sort_array(F.transform("_values", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    values = values.select(F.col(id_col).alias("_id"), by_length.alias("_values"))
    text = F.aggregate(F.coalesce("_values", F.array().cast("array<string>")), F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark)))
    return docs.join(values, docs[id_col] == values["_id"], "left").withColumn(text_col, text).drop("_id", "_values")
