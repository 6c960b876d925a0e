"""Conversation repair against a search over all edits and a plain loop over rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import repair
from marquee.llm.queries import QUERIES
from marquee.llm.repair import damage, edits, marked, repair_report, unroll

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(symbols):
    """(cost, audit, roles by row with inserted ones) by a search over (row, state), least cost then least audit."""
    nxt = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, made = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(symbols) and q in ("", "a"):
            assert LEGAL.fullmatch("".join(x[1] for x in made).lower())
            return cost, audit, made
        for letter in "ua":
            if letter in nxt[q]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, letter, made + ((None, letter),)))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, made))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial in nxt[q]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, nxt[q][initial], made + ((i, initial),)))
                for letter in "ua":
                    if letter in nxt[q]:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, letter, made + ((i, letter.upper()),)))
    raise AssertionError


def plain(rows):
    """Report of one conversation from its damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:256], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    cost, audit, made = cheapest(list(zip(initials, faults)))
    names = {"u": "user", "a": "assistant"}
    said = []
    for i, letter in made:
        if i is None:
            said.append(names[letter] + ":")
        else:
            role = names[letter.lower()] if letter.isupper() else rows[i][2]
            said.append(f"{role}:{rows[i][3]}")
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
    }


def some_rows(rng, convs, most):
    texts = ["", " \n", "a.", "b", "c?\x0b ", "d! x", " ", "long " * 80 + "end.", "long " * 80 + "end"]
    rows = []
    for conv in convs:
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice((1, 1, 1, 3))
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            rows.append((conv, rng.choice((turn, turn, turn, None)), role, rng.choice(texts + [f"t{turn}."] * 9 + [None])))
    return rows


def test_unroll_is_cheapest():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 9)
        rows = [(rng.choice("suaoSUAOx"), 1) for _ in range(n)]
        symbols = [(s.lower(), "blank" if s == "x" else "truncated" if s.isupper() else "") for s, _ in rows]
        audit, _, cost, _ = unroll(rows, repair.FINAL, [0], True)[0]
        assert (cost, audit) == cheapest(symbols)[:2]
    audit, edit, cost, _ = unroll([("u", 1_000_000), ("a", 1)], repair.FINAL, [0], True)[0]
    assert (audit, edit, cost) == ("K" + "D" * 999_999 + "K", ["K", "K"], 3 * 999_999)


@pytest.mark.parametrize("bits", [14, 1])
def test_report(spark, monkeypatch, bits):
    """Also with blocks of two rows, so that conversations are chains of blocks."""
    monkeypatch.setattr(repair, "BLOCK", bits)
    rng = random.Random(bits)
    rows = some_rows(rng, [*range(40), None], 14)
    rows += [r for r in rows if rng.random() < 0.1]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, at int")
    got = {r["conv"]: r for r in repair_report(damage(frame)).collect()}
    by = {}
    for r in plain_damage(rows):
        by.setdefault(" " if r[0] is None else str(r[0]), []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        want = plain(own)
        assert {k: got[conv][k] for k in want} == want, conv


def test_query(spark, tmp_path):
    rows = [(c, t, "user", "x.") for c in range(100, 300) for t in range(1 + c % 2)] + [(None, None, None, None), (99, None, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {*range(100, 300), None, 99}
    by = {c: [r for r in plain_damage(rows) if r[0] == c] for c in got}
    gone = [c for c, own in by.items() if not own]
    assert gone
    for c in got:
        want = plain(by[c])
        assert {k: got[c][k] for k in want} == want, c


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(none).count() == 0
    assert edits(marked(none)).filter(F.col("audit") != "").count() == 0
