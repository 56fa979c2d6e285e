"""Records across split borders, against readers of whole files."""
import csv
import io
import json
import random

import pytest

from curata.sources import read_csv, read_json, splits


@pytest.fixture()
def small_splits(spark):
    """Files of a few hundred bytes are read by many tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells(rng):
    return "".join(rng.choice(['a', 'bc', ',', '"', '\n', '\r\n', ' x', 'é', '']) for _ in range(rng.randint(1, 6)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_csv_at_every_border(small_splits, tmp_path, seed, end):
    """Each seed shifts line ends, quotes and CRLF against the borders."""
    rng = random.Random(seed)
    rows = [["id", "first", "se\ncond"]] + [[str(i), cells(rng) or "x", f"k{cells(rng)}"] for i in range(30)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    p = tmp_path / "t.csv"
    p.write_bytes(out.getvalue().encode())
    assert splits.pieces(small_splits, str(p), "\n").rdd.getNumPartitions() > 6
    df = read_csv(small_splits, str(p), infer=False)
    assert df.columns == rows[0]
    got = sorted((int(a), b, c) for a, b, c in df.collect())
    blank = {"": None}  # an empty cell is missing
    assert got == [(int(a), blank.get(b, b), c) for a, b, c in rows[1:]]


def test_stray_quotes_are_read_as_by_one_task(small_splits, tmp_path):
    text = 'a,b\n5" pipe,1\n"two\nlines"x,2\nx"y"z,3\n"say ""hi""\n",4\n' * 5
    p = tmp_path / "t.csv"
    p.write_text(text)
    one = small_splits.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(p))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, read_csv(small_splits, str(p), infer=False).collect()), key=key) == sorted(map(tuple, one.collect()), key=key)


def test_csv_folder_of_files_each_with_a_header(small_splits, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text('a,b\n' + "".join(f'{10 * i + j},"x\ny"\n' for j in range(8)) + "\n")
    (tmp_path / "9.csv").write_text('a,b\n')
    df = read_csv(small_splits, str(tmp_path))
    assert sorted(r["a"] for r in df.collect()) == [10 * i + j for i in range(3) for j in range(8)]
    assert df.dtypes == [("a", "bigint"), ("b", "string")]


def test_ends_of_csv_lines():
    for line, inside, want in [("a,b", False, False), ('"a', False, True), ('a"', False, False), ('"a""', False, True), ('"a"""', False, False), ('x",1', True, False),
                               ('x""', True, True), ('x"y,"z', True, True), ("x", True, True), ('"a"b",c', False, False), ('"a,b', False, True), ('",', True, False), ('"', True, False)]:
        assert splits.cells_end(line, inside) is want, (line, inside)


VALUES = [1, -2.5, None, True, "a}b", 'q"{[', "\\", "\\\"}", "x,y", {"k": [1, {"z": "},{"}]}, [], {}, [[1, 2], "]"], "é\nü"]


@pytest.mark.parametrize("seed, indent", [(0, None), (1, 1)])
def test_json_arrays_at_every_border(small_splits, tmp_path, seed, indent):
    rng = random.Random(seed)
    rows = [{"id": i, "s": json.dumps(rng.choice(VALUES)), "n": {"deep": [rng.choice(["}", "{", "a,b"]), {"x": None}]}} for i in range(14)]
    p = tmp_path / "t.json"
    p.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    records = splits.json_array_records(small_splits, str(p))
    assert sorted((json.loads(r["text"]) for r in records.collect()), key=lambda r: r["id"]) == rows
    assert splits.pieces(small_splits, str(p), "}").rdd.getNumPartitions() > 6
    got = read_json(small_splits, str(p)).select("id", "s", "n.deep").collect()
    assert sorted((r["id"], r["s"]) for r in got) == [(r["id"], r["s"]) for r in rows]


def test_other_arrays_are_read_whole(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text("[1, 2]")
    assert not splits.json_array_records(spark, str(p)) or splits.json_array_records(spark, str(p)).count() == 0
    p.write_text('[{"a": 1}, [2]]')
    assert splits.json_array_records(spark, str(p)) is None
    p.write_text("[]")
    assert splits.json_array_records(spark, str(p)).count() == 0


def test_a_cut_array_is_not_json(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"a": 1}, {"a": 2}')
    with pytest.raises(ValueError):
        read_json(spark, str(p))


@pytest.mark.parametrize("seed, indent", [(0, None), (1, 2)])
def test_json_by_columns_at_every_border(small_splits, tmp_path, seed, indent):
    rng = random.Random(seed)
    doc = {"a": {str(i): i for i in range(16)}, 't"x,{': {f"{i}": rng.choice(["x,y", "}", '"{', "é", "plain"]) for i in range(0, 16, 2)},
           "none": {}, "deep": {str(i): [i, {"k": "a,b"}] for i in range(16)}}
    p = tmp_path / "t.json"
    p.write_text(json.dumps(doc, indent=indent))
    df = read_json(small_splits, str(p))
    assert sorted(df.columns) == sorted(doc)
    got = {r["a"]: r for r in df.collect()}
    assert len(got) == 16
    for i in range(16):
        assert got[i]['t"x,{'] == doc['t"x,{'].get(str(i)) and got[i]["none"] is None and got[i]["deep"][0] == str(i)


def test_json_by_columns_with_many_rows(spark, tmp_path):
    """The schema doesn't grow with the rows."""
    n = 40_000
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"k": {str(i): i for i in range(n)}, "s": {str(i): f"v{i}" for i in range(n)}}))
    df = read_json(spark, str(p))
    assert df.columns == ["k", "s"] and df.count() == n and df.where("s = concat('v', k)").count() == n
