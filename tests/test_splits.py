"""CSV and JSON files cut at every place: what is read does not depend on the splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marquee.session import fresh_path
from marquee.sources import exports, pages, splits
from marquee.sources.splits import JsonItems, array_items, csv_cells, records, under_key

TEXT = (
    "﻿\r\n"
    'Name,"Note",Name,Far,,Last\r\n'
    'a,"one, ""two""\nthree\r\n\n",b,"",x, end \r\n'
    "short\n"
    "\n"
    ',"\n\n\n",,,,\n'
    'é"ü,"x,☃\n'
    'last,"no line end"'
)


def plain_csv(text):
    """Cells by a walk over characters."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    while i < len(text):
        ch, nxt = text[i], text[i + 1 : i + 2]
        if ch == '"':
            if quoted and nxt == '"':
                cell, i = cell + '"', i + 1
            else:
                quoted = not quoted
        elif quoted or ch not in ",\r\n":
            cell += ch
        elif ch != "\r":
            row.append(cell)
            cell = ""
            if ch == "\n":
                rows.append(row)
                row = []
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return [[c.strip() for c in r] for r in rows if len(r) > 1 or r[0].strip()]


def put(spark, path, text):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()


@pytest.fixture
def split_size(spark, monkeypatch):
    """Splits as a file system of tiny blocks would give them: a piece belongs to the split that its first byte lies in."""

    def size(n):
        def cut(spark, path, separator):
            rows, at, last = [], 0, None
            for r in real(spark, path, separator).coalesce(1).collect():
                at = at if r["file"] == last else 0
                rows.append((r["file"], at // n * n, r["value"]))
                last, at = r["file"], at + len(r["value"].encode()) + 1
            return spark.createDataFrame(rows, "file string, split long, value string").coalesce(1)

        real = splits.pieces
        monkeypatch.setattr(splits, "pieces", cut)

    return size


@pytest.mark.parametrize("size", [1, 2, 7, 30, 1 << 20])
def test_csv_at_any_split(spark, split_size, size):
    split_size(size)
    path = fresh_path(spark, "csv")
    put(spark, f"{path}/a.csv", TEXT)
    put(spark, f"{path}/b.csv", "x,y\n1,2\n")
    put(spark, f"{path}/empty.csv", "")
    rows = exports.read_cells(spark, path).orderBy("file", "split", "no").collect()
    header, *want = plain_csv(TEXT)
    assert [r["cells"] for r in rows if r["file"].endswith("a.csv")] == want
    assert {tuple(r["header"]) for r in rows} == {tuple(header), ("x", "y")}
    assert [r["cells"] for r in rows if r["file"].endswith("b.csv")] == [["1", "2"]]
    named = exports.read_export_csv(spark, path, ["Name", "Last", "y", "absent"]).collect()
    # Of repeated names the last counts; short records end in empty text.
    assert ("b", "end", "", "") in [tuple(r) for r in named] and ("", "", "2", "") in [tuple(r) for r in named]


def test_random_csv(spark, split_size):
    rng = random.Random(12)
    path, texts = fresh_path(spark, "csv"), []
    for n in range(6):
        body = "".join(rng.choice('ab,"\r\n ☃') for _ in range(400))
        texts.append("h1,h2\n" + body + ('"' if body.count('"') % 2 else ""))
        put(spark, f"{path}/{n}.csv", texts[-1])
    split_size(37)
    got = {}
    for r in exports.read_cells(spark, path).orderBy("file", "split", "no").collect():
        got.setdefault(int(r["file"][-5]), []).append(r["cells"])
    assert got == {n: plain_csv(t)[1:] for n, t in enumerate(texts)}


def test_any_number_of_columns(spark):
    path = fresh_path(spark, "wide")
    put(spark, f"{path}/w.csv", ",".join(f"c{i}" for i in range(500)) + "\n" + ",".join(f"v{i}" for i in range(500)) + "\n")
    row = exports.read_export_csv(spark, path, ["c0", "c96", "c499"]).first()
    assert tuple(row) == ("v0", "v96", "v499")
    put(spark, f"{path}/w.csv", ",".join([*(f"x{i}" for i in range(200)), "Const", "Title Type"]) + "\nq\n")
    assert exports.file_headers(spark, path).first()["source"] == "imdb"


def test_cells():
    assert csv_cells('a,"b""c",,"" ,"x"y') == ["a", 'b"c', "", " ", "xy"]


ITEMS = [{"t": 'br{ce} "q" \\ ]', "n": {"deep": [{"x": 1}, []]}}, {"t": "}"}, {"t": "\\"}, {}, {"t": "é☃", "n": None}, {"t": "last"}]


@pytest.mark.parametrize("size", [1, 3, 20, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_at_any_split(spark, split_size, size, indent):
    split_size(size)
    path = fresh_path(spark, "json")
    put(spark, f"{path}/one.json", json.dumps(ITEMS, indent=indent, ensure_ascii=False))
    put(spark, f"{path}/none.json", "[]")
    found = records(spark, path, JsonItems()).orderBy("split", "no").collect()
    assert [json.loads(r["text"]) for r in found] == ITEMS
    wrapped = {"other": ITEMS[:2], "movies": ITEMS, "size": {"movies": [1]}, "shows": [], "more": ITEMS[3:]}
    put(spark, f"{fresh_path(spark, 'x')}/skip.json", "")
    path = fresh_path(spark, "json")
    put(spark, f"{path}/two.json", json.dumps(wrapped, indent=indent, ensure_ascii=False))
    found = records(spark, path, JsonItems(2))
    of = lambda key: [json.loads(r["text"]) for r in under_key(found, key).orderBy("split", "no").collect()]
    assert of("movies") == ITEMS and of("other") == ITEMS[:2] and of("more") == ITEMS[3:] and of("shows") == []


def test_load_json_reads_what_is_json(spark):
    path = fresh_path(spark, "json")
    put(spark, f"{path}/a.json", '[{"title": "A", "year": 1}, {"title": oops}, {"title": "C", "imdb": 1.5, "unknown": {"x": []}}]')
    got = {(r["title"], r["year"], r["imdb"]) for r in pages.load_json(spark, path).collect()}
    assert got == {("A", 1, None), ("C", None, 1.5)}


def test_files_are_read_by_several_tasks(spark):
    """Real splits: one array and one table with quoted line ends, in some twenty parts each."""
    path = fresh_path(spark, "big")
    put(spark, f"{path}/json/a.json", json.dumps([{"title": f"t{i}", "pos": i} for i in range(2000)]))
    put(spark, f"{path}/csv/a.csv", "n,note\n" + "".join(f'{i},"line\n""{i}"",\n"\n' for i in range(2000)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        tasks = splits.pieces(spark, f"{path}/json", "}").select("split").distinct().count()
        items, lines = pages.load_json(spark, f"{path}/json"), exports.read_export_csv(spark, f"{path}/csv", ["n", "note"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 15
    assert items.count() == 2000 and items.agg(F.sum("pos")).first()[0] == 1999000
    assert {(r["n"], r["note"]) for r in lines.collect()} == {(str(i), f'line\n"{i}",') for i in range(2000)}


def test_table_function(spark):
    """Arrays in strings, nested, broken, with broken items; several names; SQL with a lateral call."""
    first = 'x = "["; const A  = [{"t": "a ] b [ \\" c", "n": [1, [2]]}, 7, [{"no": 1}], {"t": "d"}];\nconst B = [{"t": "lost"}, broken'
    rows = [(1, first), (2, "const A=[]"), (3, None), (4, "nothing"), (5, 'const A = [{"t": "ok"}, {t: bad}]; const AB = [{"t": "other"}]')]
    frame = spark.createDataFrame(rows, "id long, html string")
    got = pages.extract_embedded_array(frame, "A", schema=pages.T.StructType().add("t", "string"))
    assert {(r["id"], r["t"]) for r in got.collect()} == {(1, 'a ] b [ " c'), (1, "d"), (5, "ok")}
    assert pages.extract_embedded_array(frame, "B").count() == 0
    pages.register_embedded_items(spark)
    frame.createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT id, no, item FROM some_pages, LATERAL embedded_items(html, 'AB') WHERE no = 0").collect()
    assert [tuple(r) for r in found] == [(5, 0, '{"t": "other"}')]
    assert array_items('[{"a": {"b": "}"}}, "{", {}]', 0) == ['{"a": {"b": "}"}}', "{}"]
