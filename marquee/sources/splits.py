"""Files whose records span lines, read in parallel: one file by many tasks.

Spark cuts a file into splits and a split into pieces at a separator byte. Where a record ends depends on what stands before it: whether
a quote is open, how deep the brackets are. A machine (see Machine) tells the effect of a piece on that
state. Pass one composes the effects of each split, whatever state it starts in. A chain over a file's splits, one small
row each, gives every split its state on entry. Pass two cuts each split into records. What a split begins or ends in the middle of
comes out as a fragment; fragments are put together by file.

Tasks hold one piece and the record at hand. The only sequence is the chain: one row per split of a file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise

#: Splits whose states travel to all tasks; of more files than that, pieces meet their states in a join.
SHIPPED = 100_000
EFFECT = "array<bigint>"


class Machine:
    """States are lists of whole numbers, effects too.

    `separator` ends a piece. `start` is the state at the head of a file. `effect(piece)` is what a piece does,
    `compose(first, then)` what two effects do, `apply(effect, state)` the state behind. `step(piece, state)` gives
    (state behind, parts): parts are (text, opens, closes): a part of a record that opens it, closes it, both or neither.
    """

    separator: str
    start: list[int]

    def effect(self, piece: str) -> list[int]:
        raise NotImplementedError

    def compose(self, first: list[int], then: list[int]) -> list[int]:
        raise NotImplementedError

    def apply(self, effect: list[int], state: list[int]) -> list[int]:
        raise NotImplementedError

    def step(self, piece: str, state: list[int]) -> tuple[list[int], list[tuple[str, bool, bool]]]:
        raise NotImplementedError


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, split (its first byte), value: in the order of the file within a task and split."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batches) -> Iterator[tuple[tuple, list[str], dict]]:
    """(file and split, pieces, first row's further columns) of runs of rows; a split can come in several runs."""
    for batch in batches:
        files, splits, values = (batch.column(c).to_pylist() for c in ("file", "split", "value"))
        more = [n for n in batch.schema.names if n not in ("file", "split", "value")]
        a = 0
        while a < len(files):
            b = a + 1
            while b < len(files) and splits[b] == splits[a] and files[b] == files[a]:
                b += 1
            yield (files[a], splits[a]), values[a:b], {n: batch.column(n)[a].as_py() for n in more}
            a = b


def _effects(machine: Machine):
    def run(batches):
        key, total = None, None

        def out():
            return pa.RecordBatch.from_pydict({"file": [key[0]], "split": [key[1]], "effect": [total]})

        for now, values, _ in _by_split(batches):
            if now != key:
                if key is not None:
                    yield out()
                key, total = now, None
            for v in values:
                e = machine.effect(v)
                total = e if total is None else machine.compose(total, e)
        if key is not None:
            yield out()

    return run


def _states(machine: Machine):
    """A file's splits in order -> state on entry to each."""

    def run(batches):
        for batch in batches:
            for file, chain in zip(batch.column("file").to_pylist(), batch.column("chain").to_pylist()):
                state, out = machine.start, []
                for x in chain:
                    out.append(state)
                    state = machine.apply(x["effect"], state)
                yield pa.RecordBatch.from_pydict({"file": [file] * len(chain), "split": [x["split"] for x in chain], "state": out})

    return run


PARTS = "file string, split bigint, no bigint, opens boolean, closes boolean, text string"


def _parts(machine: Machine, rows_out: int = 4096):
    """Pieces with the state on entry to their split -> records and fragments, numbered within the split."""
    names = [p.split()[0] for p in PARTS.split(", ")]

    def run(batches):
        rows: list[tuple] = []
        key, state, no, held, opened = None, None, 0, [], False

        def out():
            got = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(got, names)

        for now, values, more in _by_split(batches):
            if now != key:
                if held:
                    rows.append((*key, no, opened, False, "".join(held)))
                key, state, no, held, opened = now, more["state"], 0, [], False
            for v in values:
                state, parts = machine.step(v, state)
                for text, opens, closes in parts:
                    if opens:
                        opened = True
                    held.append(text)
                    if closes:
                        rows.append((*key, no, opened, True, "".join(held)))
                        no, held, opened = no + 1, [], False
                if len(rows) >= rows_out:
                    yield out()
        if held:
            rows.append((*key, no, opened, False, "".join(held)))
        if rows:
            yield out()

    return run


def records(spark: SparkSession, path: str, machine: Machine) -> DataFrame:
    """file, split, no, text of every record, in the order of (split, no) within a file; stored."""
    cut = pieces(spark, path, machine.separator)
    effects = cut.mapInArrow(_effects(machine), f"file string, split bigint, effect {EFFECT}")
    chain = effects.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("split", "effect"))).alias("chain"))
    states = materialise(chain.mapInArrow(_states(machine), f"file string, split bigint, state {EFFECT}"), "states")
    # Pieces stay in order in a broadcast join; any other join moves them, so they are put in order again.
    if states.count() <= SHIPPED:
        ready = cut.join(F.broadcast(states), ["file", "split"])
    else:
        placed = cut.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "split"])
        ready = placed.repartition("file", "split").sortWithinPartitions("file", "split", "at").drop("at")
    parts = materialise(ready.mapInArrow(_parts(machine), PARTS), "parts")
    whole = parts.filter("opens and closes").select("file", "split", "no", "text")
    # At most two fragments per split, and one for each split within a record.
    order = Window.partitionBy("file").orderBy("split", "no")
    torn = parts.filter("not (opens and closes)").withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    member = F.struct("split", "no", "text")
    mended = torn.groupBy("file", "record").agg(F.sort_array(F.collect_list(member)).alias("ms"), F.max("opens").alias("opens")).filter("opens")
    mended = mended.select("file", F.col("ms")[0]["split"].alias("split"), F.col("ms")[0]["no"].alias("no"), F.array_join("ms.text", "").alias("text"))
    return whole.unionByName(mended)


# ------------------------------------------------------------------ CSV


class CsvLines(Machine):
    """Pieces are lines; a line end ends a record unless a quote is open. Each quote opens or closes, a doubled one both.

    State: [whether a quote is open, whether the line opens a record]; effect: [parity of the quotes]."""

    separator = "\n"
    start = [0]

    def effect(self, piece):
        return [piece.count('"') & 1]

    def compose(self, first, then):
        return [first[0] ^ then[0]]

    apply = compose

    def step(self, piece, state):
        opens = not state[0]
        state = [state[0] ^ (piece.count('"') & 1)]
        # A line end within quotes belongs to the cell.
        return state, [(piece + "\n" if state[0] else piece, opens, not state[0])]


def csv_cells(record: str) -> list[str]:
    """Cells of one record. Outside of quotes commas end cells and carriage returns do not count; a doubled quote inside is one, and
    a carriage return with a line feed is one line end."""
    if '"' not in record:
        return record.replace("\r", "").split(",")
    cells, cell = [], []
    runs = record.split('"')
    for k, run in enumerate(runs):
        if k % 2:
            cell.append(run.replace("\r\n", "\n"))
        elif not run and 0 < k < len(runs) - 1:
            cell.append('"')
        else:
            first, *rest = run.replace("\r", "").split(",")
            cell.append(first)
            for nxt in rest:
                cells.append("".join(cell))
                cell = [nxt]
    cells.append("".join(cell))
    return cells


# ------------------------------------------------------------------ JSON

_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_KEY_FOLLOWS = re.compile(r"\s*:")
#: Stands before the name of a key of the outer object, as a record of its own.
KEY_MARK = "\x00"


class JsonItems(Machine):
    """Records are the objects of an array that lies `depth` brackets deep; with depth 2 the keys of the outer object come along.

    Pieces end at closing braces, so a piece can begin inside a string, and at most one item opens in it.
    State: [whether a string is open, depth]; effect: both changes, for a piece that begins outside and inside of a string."""

    separator = "}"
    start = [0, 0]

    def __init__(self, depth: int = 1):
        self.depth = depth

    def effect(self, piece):
        plain = _ESCAPED.sub("", piece) if "\\" in piece else piece
        runs = plain.split('"')
        levels = [r.count("{") + r.count("[") - r.count("]") for r in runs]
        ends = len(runs) - 1 & 1
        # Runs take turns outside and inside of strings; the brace at the end counts where no string is open.
        return [ends, sum(levels[::2]) - (not ends), ends ^ 1, sum(levels[1::2]) - ends]

    def compose(self, first, then):
        return [v for s in (0, 1) for v in self.apply(then, [first[2 * s], first[2 * s + 1]])]

    def apply(self, effect, state):
        s, depth = state
        return [effect[2 * s], depth + effect[2 * s + 1]]

    def step(self, piece, state):
        behind = self.apply(self.effect(piece), state)
        closes = behind == [0, self.depth]
        if state[1] > self.depth:
            return behind, [(piece + "}", False, closes)]
        parts, at, depth = [], 0, state[1]
        if state[0]:
            end = _STRING_END.match(piece)
            at = end.end() if end else len(piece)
        for token in _TOKEN.finditer(piece, at):
            first = token[0][0]
            if first == '"':
                if depth == self.depth - 1 and self.depth == 2 and _KEY_FOLLOWS.match(piece, token.end()):
                    parts.append((KEY_MARK + json.loads(token[0]), True, True))
            elif first == "{" and depth == self.depth:
                return behind, [*parts, (piece[token.start() :] + "}", True, closes)]
            else:
                depth += 1 if first in "{[" else -1
        return behind, parts


def under_key(found: DataFrame, key: str) -> DataFrame:
    """Records of JsonItems(2) that stand under a key of the outer object. Windows see one split, or one row per split of a file."""
    is_key = F.substring("text", 1, 1) == KEY_MARK
    marked = found.withColumn("key", F.when(is_key, F.substring("text", 2, F.length("text"))))
    last = marked.groupBy("file", "split").agg(F.max_by("key", F.when(is_key, F.col("no"))).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    entry = last.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("entry"))
    here = Window.partitionBy("file", "split").orderBy("no")
    named = marked.withColumn("own", F.last("key", ignorenulls=True).over(here)).join(entry, ["file", "split"])
    return named.filter(~is_key & (F.coalesce("own", "entry") == key)).select("file", "split", "no", "text")


def array_items(text: str, at: int) -> list[str]:
    """Objects of the array that opens at a place; none if it never closes."""
    out, depth, begun = [], 0, 0
    for token in _TOKEN.finditer(text, at):
        first = token[0][0]
        if first in "{[":
            depth += 1
            if depth == 2 and first == "{":
                begun = token.start()
        elif first in "}]":
            depth -= 1
            if depth == 1 and first == "}":
                out.append(text[begun : token.end()])
            elif depth == 0:
                return out
    return []
