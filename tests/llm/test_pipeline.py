"""The pipeline stage by stage against plain reckonings, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from marquee.session import materialise

from .test_text_operators import plain_classes, split

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").withColumn("score", F.lit(0.5))
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    one = docs.filter("doc_id = 1").first()["text"]
    extra = [
        (1000, None, None, None, None, None), (1001, "12 34", "en", "s", 5, None), (1002, one, "en", "s", 1, None), (1003, one + " more", "en", "s", 1, None),
        (1004, f"{one[:80]} {bench[1]} {one[80:160]}", "en", "s", 1, None), (1005, 'the of and to in is token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" that was', "en", None, 1, None),
        (1006, "the of and", "en", "s", 10, None), (1006, "the of and", "en", "s", 10, None), (None, "and the of no id was here", "en", "s", 10, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    return out


def ids(frame):
    return sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_stages(stages):
    docs, spoken, single, clean, safe, packed = stages
    assert [s.columns for s in stages[1:5]] == [corpus_pipeline.COLUMNS] * 4
    assert ids(spoken) == [i for i in ids(docs) if i not in (1000, 1001)]
    assert {r["text"] for r in spoken.select("text").collect()} <= {r["text"] for r in docs.select("text").collect()}
    rows = [(r["doc_id"], r["text"]) for r in spoken.collect() if r["doc_id"] is not None]
    classes = plain_classes(list(dict(rows).items()))
    assert ids(single) == sorted({c for c in classes.values()}) + [None]
    held = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    bench = [split(r["text"]) for r in single.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in single.collect() if any(" ".join(b) in " ".join(split(r["text"])) for b in bench if len(b) >= 8)}
    assert held == whole and 1004 in held
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in safe.collect()}
    assert "24be64439e3e" not in texts[1005][0] and '[secret]' in texts[1005][0] and texts[1005][1] == len(texts[1005][0])
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert set(ids(packed)) == set(ids(safe))


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_warc", "op11_spelling_variants", "op12_conversation_repair"])
def test_oracles(spark, name):
    from tests.oracle_check import compare, duck

    status, _, note = compare(spark, duck(SF), SF, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert status == "ok", note
