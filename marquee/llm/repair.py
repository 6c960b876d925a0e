"""Conversation repair: cheapest edits that make the roles legal, by a run-length dynamic programme.

A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no white space is none of `.!?`). Legal roles are (s?(ua)+)?, a machine of four states: at the
start, behind a system, user or assistant row. Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and
duplicate rows), Insert an empty user or assistant row 2; a truncated row that stays adds 1. Of the cheapest edits those
whose initials are least in ASCII order are taken.

A row is one symbol: the initial of its role, whether it is truncated, or "must go". Its effect is a 4 x 4 min-plus
matrix: the least cost from a state before it to a state behind it. Equal consecutive symbols are one run, whose effect
is a product of cached binary powers of that matrix. Going back over the runs gives the cost still to come at their ends;
going forward, each row takes the least edit that keeps to that cost. Each state allows one role for Rerole and one for Insert, so the
initials say all.

Equal rows of a turn are one row with a count. Rows are put in order by a range exchange over conversation and turn, so a
long conversation is spread over tasks; at most BLOCK counted rows of a conversation make a block. Blocks of one conversation
are summed up as matrices, chained from the last to the first (cost to come) and from the first to the last (state on
entry), and unrolled in parallel. The chain holds one matrix per block: a conversation's edits are one string of less than
2^31 characters, so these are at most 131,072. The digest of a conversation is a hash in order, so its rows stream through one task.

Defined results: null role and text are one space; null turns come first; a null conversation is one of its own; rows of one turn are ordered by role, the first
256 characters of the text, then its MD5; a role counts by its first character, an empty one as any other role; repeated rows are
duplicates; a conversation without rows has no edits; gaps beyond a long are null; further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Bits of the number of counted rows in a block.
BLOCK = 14
BLANKS = " \t\n\x0b\f\r"

#: States: start, behind system, behind user, behind assistant; the one that an inserted or renamed row leads to, and its role.
BEHIND = (2, 2, 3, 2)
LETTER = "uuau"
NAMES = {"u": "user", "a": "assistant"}
#: Initial -> state before -> state behind a kept row.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
MUST_GO = "x"
FAR = 1 << 60


def _closed(row: list[list[int]]) -> tuple:
    """Matrix of a row with rows inserted before it."""
    out = []
    for q in range(4):
        best, at, paid = list(row[q]), q, 0
        for _ in range(2):
            at, paid = BEHIND[at], paid + INSERT
            best = [min(b, paid + c) for b, c in zip(best, row[at])]
        out.append(tuple(best))
    return tuple(out)


def _row(symbol: str) -> list[list[int]]:
    row = [[FAR] * 4 for _ in range(4)]
    cut = CUT * symbol.isupper()
    for q in range(4):
        row[q][q] = DELETE
        if symbol != MUST_GO:
            row[q][BEHIND[q]] = min(row[q][BEHIND[q]], REROLE + cut)
            if q in (kept := KEPT[symbol.lower()]):
                row[q][kept[q]] = min(row[q][kept[q]], cut)
    return row


#: Cost still to come behind the last row: a user row wants an answer, a system row both.
FINAL = tuple(r[0] for r in _closed([[0, FAR, FAR, FAR], [FAR] * 4, [FAR] * 4, [0, FAR, FAR, FAR]]))


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two matrices."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(r)) for j in range(4)) for r in a)


def applied(m: tuple, v: tuple) -> tuple:
    return tuple(min(x + y for x, y in zip(r, v)) for r in m)


#: What was reckoned before, in a task: powers by symbol and exponent; steps by symbol, number of rows and cost to come.
_POWERS: dict = {}
_STEPS: dict = {}
MOST_STEPS = 100_000


def power(symbol: str, j: int) -> tuple:
    """Matrix of 2^j equal rows."""
    got = _POWERS.get((symbol, j))
    if got is None:
        got = _closed(_row(symbol)) if j == 0 else times(power(symbol, j - 1), power(symbol, j - 1))
        _POWERS[symbol, j] = got
    return got


def remembered(key: tuple, make):
    got = _STEPS.get(key)
    if got is None:
        if len(_STEPS) >= MOST_STEPS:
            _STEPS.clear()
        got = _STEPS[key] = make()
    return got


def _bits(n: int):
    return (j for j in range(n.bit_length()) if n >> j & 1)


def _through(symbol: str, n: int, v: tuple) -> tuple:
    for j in _bits(n):
        v = applied(power(symbol, j), v)
    return v


def through(symbol: str, n: int, v: tuple) -> tuple:
    """Cost to come before n equal rows, from that behind them."""
    least = min(v)
    low = tuple(c - least for c in v)
    return tuple(c + least for c in remembered((symbol, n, low), lambda: _through(symbol, n, low)))


def _choices(symbol: str, v: tuple) -> tuple:
    """For each state before a row: (initials, letters of inserted rows and what becomes of the row, state behind)."""
    before, out = applied(power(symbol, 0), v), []
    cut = CUT * symbol.isupper()
    for q in range(4):
        ops, edit, left = "", "", before[q]
        while True:
            if left == DELETE + v[q]:
                out.append((ops + "D", edit + "-", q))
                break
            if left == INSERT + before[BEHIND[q]]:
                ops, edit, left, q = ops + "I", edit + LETTER[q], left - INSERT, BEHIND[q]
                continue
            kept = KEPT[symbol.lower()].get(q) if symbol != MUST_GO else None
            if kept is not None and left == cut + v[kept]:
                out.append((ops + "K", edit + "K", kept))
            else:
                out.append((ops + "R", edit + LETTER[q].upper(), BEHIND[q]))
            break
    return tuple(out)


def choices(symbol: str, v: tuple) -> tuple:
    least = min(v)
    low = tuple(c - least for c in v)
    return remembered((symbol, low), lambda: _choices(symbol, low))


def runs_of(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(symbol, count of equal rows) -> runs; what follows the first of equal rows must go."""
    flat = ((s, n) for symbol, c in rows for s, n in ((symbol, 1), (MUST_GO, c - 1)) if n)
    return [(s, sum(n for _, n in g)) for s, g in groupby(flat, key=lambda x: x[0])]


def matrix_of(rows: list) -> tuple:
    out = None
    for symbol, n in runs_of(rows):
        for j in _bits(n):
            m = power(symbol, j)
            out = m if out is None else times(out, m)
    return out


def unroll(rows: list[tuple[str, int]], to_come: tuple, states: list[int], last: bool):
    """Per entry state: (initials, edit of each counted row, cost to come on entry, state on exit)."""
    runs = runs_of(rows)
    behind, v = [], to_come
    for symbol, n in reversed(runs):
        behind.append(v)
        v = through(symbol, n, v)
    steps: list = []
    for (symbol, n), w in zip(runs, reversed(behind)):
        if symbol == MUST_GO:
            # Deleting comes first: a deletion leaves the state as it is and D is the least initial.
            steps.append(n)
            continue
        run = []
        for _ in range(n):
            run.append(choices(symbol, w))
            w = through(symbol, 1, w)
        steps += reversed(run)
    out = []
    for entry in states:
        q, initials, kept = entry, [], []
        for step in steps:
            if type(step) is int:
                initials.append("D" * step)
            else:
                ops, edit, q = step[q]
                initials.append(ops)
                kept.append(edit)
        rest = iter(kept)
        edits = ["" if symbol == MUST_GO else next(rest) for symbol, _ in rows]
        if last:
            while q not in (0, 3):
                initials.append("I")
                edits[-1] += LETTER[q]
                q = BEHIND[q]
        out.append(("".join(initials), edits, v[entry], q))
    return out


def _blocks_of(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield r, [(x["symbol"], x["c"]) for x in r["rows"]]


def _matrices(batches):
    for r, rows in _blocks_of(batches):
        yield pa.RecordBatch.from_pydict({"conv": [r["conv"]], "block": [r["block"]], "m": [[c for line in matrix_of(rows) for c in line]]})


def _costs_to_come(batches):
    for batch in batches:
        for r in batch.to_pylist():
            v, out = FINAL, []
            for x in reversed(r["chain"]):
                out.append(v)
                v = applied(tuple(tuple(x["m"][i : i + 4]) for i in (0, 4, 8, 12)), v)
            yield pa.RecordBatch.from_pydict({"conv": [r["conv"]] * len(out), "block": [x["block"] for x in reversed(r["chain"])], "to_come": [list(v) for v in out]})


def _exits(batches):
    for r, rows in _blocks_of(batches):
        exits = [got[3] for got in unroll(rows, tuple(r["to_come"]), [0, 1, 2, 3], False)]
        yield pa.RecordBatch.from_pydict({"conv": [r["conv"]], "block": [r["block"]], "exits": [exits]})


def _entries(batches):
    for batch in batches:
        for r in batch.to_pylist():
            q, out = 0, []
            for x in r["chain"]:
                out.append(q)
                q = x["exits"][q]
            n = len(out)
            yield pa.RecordBatch.from_pydict({"conv": [r["conv"]] * n, "block": [x["block"] for x in r["chain"]], "entry": out, "is_last": [k == n - 1 for k in range(n)]})


UNROLLED = "conv string, block long, audit string, to_pay long, illegal long, head string, tail string, edits array<struct<at:bigint,edit:string>>"


def _unrolled(batches):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("at", pa.int64()), ("edit", pa.string())]))]
    names = ["conv", "block", "audit", "to_pay", "illegal", "head", "tail", "edits"]
    for batch in batches:
        cols = [[] for _ in kinds]
        for r, rows in _blocks_of([batch]):
            to_come = FINAL if r["to_come"] is None else tuple(r["to_come"])
            audit, edits, to_pay, _ = unroll(rows, to_come, [r["entry"]], r["is_last"])[0]
            letters = [x["initial"] for x in r["rows"]]
            bad = sum(c - 1 for _, c in rows) + sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
            edits = [{"at": x["at"], "edit": e} for x, e in zip(r["rows"], edits) if e not in ("", "-")]
            for c, value in zip(cols, (r["conv"], r["block"], audit, to_pay, bad, letters[0], letters[-1], edits)):
                c.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def _keyed(turns: DataFrame, id_col: str) -> DataFrame:
    """Rows with their keys: conversation and turn as strings, the head and digest of the text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(said(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), said("turn").alias("turn_key"), said("role").alias("role"), said("text").alias("text"))
    return rows.withColumn("h", F.md5("text"))


def marked(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per distinct row of a conversation: its place `at`, its count, its fault and symbol; stored. `at` is in order."""
    rows = _keyed(turns, id_col)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select(
        "conv", "turn", "turn_key", "role", F.substring("text", 1, 256).alias("first"), "h",
        (body == "").alias("is_blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    key = ["conv", "turn", "turn_key", "role", "first", "h"]
    counted = materialise(narrow.groupBy(*key, "is_blank", "is_cut").agg(F.count("*").alias("c")), "counted")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = counted.groupBy("conv", "role", "h").agg(F.min(when).alias("since"), F.count("*").alias("turns")).filter("turns > 1").drop("turns")
    seen = counted.join(again, ["conv", "role", "h"], "left").withColumn("is_copy", F.coalesce(F.col("since") < when, F.lit(False)))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("is_blank") | F.col("is_copy"), MUST_GO).when(F.col("is_cut"), F.upper(letter)).otherwise(letter)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "first"]
    placed = seen.repartitionByRange(*order).sortWithinPartitions(*order, "h")
    return materialise(placed.select("*", letter.alias("initial"), symbol.alias("symbol"), F.monotonically_increasing_id().alias("at")).drop("since", "first"), "marked")


def faults(marks: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated of every conversation that has rows."""
    clean = ~F.col("is_blank") & ~F.col("is_copy")
    copies = F.when(F.col("is_blank"), 0).when(F.col("is_copy"), F.col("c")).otherwise(F.col("c") - 1)
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1) - F.countDistinct("turn"))
    return marks.groupBy("conv").agg(
        F.when(F.count("turn") == 0, F.lit(0)).otherwise(span).cast("long").alias("gaps"),
        F.sum(F.when(F.col("is_blank"), F.col("c")).otherwise(0)).alias("blank"),
        F.sum(copies).alias("duplicate"),
        F.sum((clean & F.col("is_cut")).cast("long")).alias("truncated"),
    )


def _chained(frame: DataFrame, what: str) -> DataFrame:
    return frame.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", what))).alias("chain"))


def edits(marks: DataFrame) -> DataFrame:
    """Unrolled blocks of all conversations; stored."""
    row = F.struct("at", "initial", "symbol", "c")
    blocks = marks.groupBy("conv", F.shiftright("at", BLOCK).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = materialise(blocks, "blocks")
    long = blocks.join(blocks.groupBy("conv").count().filter("count > 1"), "conv", "left_semi")
    key = "conv string, block long"
    summed = long.mapInArrow(_matrices, f"{key}, m array<bigint>")
    to_come = materialise(_chained(summed, "m").mapInArrow(_costs_to_come, f"{key}, to_come array<bigint>"), "to_come")
    exits = long.join(to_come, ["conv", "block"]).mapInArrow(_exits, f"{key}, exits array<bigint>")
    entries = _chained(exits, "exits").mapInArrow(_entries, f"{key}, entry bigint, is_last boolean")
    whole = blocks.join(to_come, ["conv", "block"], "left").join(entries, ["conv", "block"], "left")
    ready = whole.select("conv", "block", "rows", "to_come", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("is_last", F.lit(True)).alias("is_last"))
    return materialise(ready.mapInArrow(_unrolled, UNROLLED), "unrolled")


def audits(unrolled: DataFrame) -> DataFrame:
    """conv, audit (initials of the edits), cost, illegal (adjacent roles out of order) of every conversation that has rows."""
    parts = unrolled.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "audit", "to_pay", "illegal", "head", "tail"))).alias("ps"))
    pairs = F.zip_with(F.slice("ps", 1, F.size("ps") - 1), F.slice("ps", 2, F.size("ps")), lambda a, b: F.concat(a["tail"], b["head"]))
    between = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    inside = F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + p["illegal"])
    return parts.select("conv", F.array_join("ps.audit", "").alias("audit"), F.col("ps")[0]["to_pay"].alias("cost"), (inside + between).alias("illegal"))


def repaired(turns: DataFrame, marks: DataFrame, unrolled: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows of the repaired conversations, in the order of (conv, at, k): conv, at, k, role, text, edit (K, R or I)."""
    key = ["conv", "turn_key", "role", "h"]
    each = unrolled.select(F.explode("edits").alias("e")).select("e.at", "e.edit").join(marks.select("at", *key), "at")
    texts = _keyed(turns, id_col).groupBy(*key).agg(F.first("text").alias("text"))
    both = each.join(texts, key)
    letter = F.col("c")
    named = F.when(F.lower(letter) == "u", "user").otherwise("assistant")
    out = both.select("conv", "at", "role", "text", F.posexplode(F.split("edit", "")).alias("k", "c")).filter(~letter.isin("", "-"))
    return out.select(
        "conv", "at", "k", F.when(letter == "K", F.col("role")).otherwise(named).alias("role"),
        F.when(letter.isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        F.when(letter == "K", "K").when(letter.isin("u", "a"), "I").otherwise("R").alias("edit"),
    )


def _hashed(batches):
    now, h = None, None
    for batch in batches:
        convs, hashes = [], []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if conv != now:
                if h is not None:
                    convs.append(now)
                    hashes.append(h.hexdigest())
                now, h = conv, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"conv": pa.array(convs, pa.string()), "repaired_sha256": pa.array(hashes, pa.string())})
    if h is not None:
        yield pa.RecordBatch.from_pydict({"conv": [now], "repaired_sha256": [h.hexdigest()]})


def digests(rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256: rows `role:text`, joined by line ends. Rows of a conversation stream through one task, in order."""
    ordered = rows.select("conv", "at", "k", "role", "text").repartition("conv").sortWithinPartitions("conv", "at", "k")
    return ordered.mapInArrow(_hashed, "conv string, repaired_sha256 string")


def damage(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows damaged by the checksum of their conversation and turn: dropped, emptied, cut, repeated, or said by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(id_col), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.withColumn("kind", kind).filter("kind <> 0")
    rows = rows.select(id_col, "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def repair_report(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation that has rows."""
    marks = marked(turns, id_col)
    unrolled = edits(marks)
    rows = repaired(turns, marks, unrolled, id_col)
    found = faults(marks).join(audits(unrolled), "conv").join(digests(rows), "conv", "left")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
