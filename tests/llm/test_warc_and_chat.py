"""Archives round trip and chat formatting, with awkward rows."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from marquee.llm.chat import Template, digest, format_conversations, read_back
from marquee.llm.warc import archive_folder, frames, full_payloads, open_store, read_archives, write_archives

PAGES = [
    (5, "http://a/x y%0A", "same body " * 30, "clash"),
    (3, "http://b", "same body " * 30, "clash"),
    (9, None, "same body " * 30, None),
    (1, "http://c\r\nX: y", None, None),
    (2, "http://d", "", None),
    (7, "http://é", "WARC/1.1\r\n\r\nfake €", None),
    (None, "http://e", "alone", None),
    (8, "http://f", "x" * 3_000_000, None),
] + [(100 + i, f"http://p/{i}", f"<html><p>page {i} of the archive</p>" * 20, None) for i in range(60)]


def pages_frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").withColumn("payload", F.col("html").cast("binary"))


def test_round_trip(spark):
    manifest = write_archives(pages_frame(spark), archive_folder(spark))
    got = {r["page_id"]: r for r in full_payloads(read_archives(manifest)).collect()}
    first = {}
    for i, _, html, _ in sorted(PAGES, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", i)
    for i, url, html, _ in PAGES:
        body = (html or "").encode()
        r = got[i]
        assert r["url"] == url and bytes(r["payload"]) == body and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))


def test_files_stand_alone(spark):
    """A file is a skippable frame with a dictionary, then frames that need it."""
    manifest = write_archives(pages_frame(spark), archive_folder(spark))
    total = 0
    for row in manifest.collect():
        store, path = open_store(row["path"])
        raw = store.open_input_stream(path).read()
        magic, n = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and raw[8 : 8 + n] and len(raw) == row["bytes"]
        assert zstandard.get_frame_parameters(raw[8 + n :]).dict_id == zstandard.ZstdCompressionDict(raw[8 : 8 + n]).dict_id()
        total += sum(1 for _ in frames(io.BytesIO(raw)))
        with pytest.raises(ValueError):
            list(frames(io.BytesIO(raw[:-3])))
    assert total == len(PAGES)


def test_min_bytes_empty_and_repeated(spark):
    frame = pages_frame(spark, [(1, "u", "ab", None), (2, "u", "ab", None), (4, "u", "abcdef", None), (4, "u", "abcdef", None), (6, "u", "abcdef", None)])
    got = sorted((r["page_id"], r["record_type"]) for r in read_archives(write_archives(frame, archive_folder(spark), min_bytes=3)).collect())
    assert got == [(1, "response"), (2, "response"), (4, "response"), (4, "response"), (6, "revisit")]
    assert read_archives(write_archives(frame.limit(0), archive_folder(spark))).count() == 0


TURNS = [
    (1, 0, "system", "be ### brief </turn>\n### User: x"),
    (1, 1, "user", "a\\b \\\\ <\\/turn> #\\## ###"),
    (1, 2, "assistant", "ok\\"),
    (2, 0, "assistant", "first"),
    (3, 0, "user", None),
    (3, 1, "assistant", ""),
    (4, 0, "tool: ###", "z"),
    (4, 1, None, "no role"),
    (4, 1, None, "no role"),
    (None, None, "user", "lost"),
    (5, 1, "assistant", "x" * 200_000 + "<" * 5000),
    (5, 0, "user", "### " * 5000),
    (6, 0, "Assistant", "other case"),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*t, 1, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    out = {r["conv_id"]: r for r in read_back(format_conversations(frame)).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert out[conv]["loss_text"] == "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert out[conv]["formatted"].count(Template().end) == len(mine)
    valid = {k: r["is_valid"] for k, r in out.items()}
    assert valid == {1: True, 2: False, 3: True, 4: False, None: False, 5: True, 6: False}
    got = {r["conv_id"]: r for r in digest(format_conversations(frame)).collect()}
    text = "".join(f"{r}\n{t}\n" for r, t in (("system", TURNS[0][3]), ("user", TURNS[1][3]), ("assistant", TURNS[2][3])))
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[3]["loss_chars"] == 0 and got[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digest(format_conversations(frame.limit(0))).count() == 0


def test_another_template(spark):
    other = Template(
        heads={"user": "[U]", "assistant": "[A]"}, other_head=("[?", "]"), end="[END]", control=("[U]", "[A]", "[?", "[END]"), loss_roles=("user", "assistant"),
        moves={("start", "user"): "u", ("u", "user"): "u", ("u", "assistant"): "done"}, accepting=("done",),
    )
    frame = spark.createDataFrame([(1, 0, "user", "[A][END]"), (1, 1, "user", "\\"), (1, 2, "assistant", "[U]")], "conv_id long, turn long, role string, text string")
    r = read_back(format_conversations(frame, other), other).first()
    assert r["is_valid"] and [t["text"] for t in r["turns"]] == ["[A][END]", "\\", "[U]"] and r["loss_text"] == "[A][END]\\[U]"


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = digest(format_conversations(frame))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
