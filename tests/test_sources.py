import glob
import json

import pytest

from curata.sources import load_table, normalize_types, read_csv, read_json, write_csv, write_csv_file
from curata.sources.readers import preview, read_sample


def test_csv_tokens_and_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d,e\n1,1.5,x,True,NA\n2,N/A,  y ,false,\nNULL,3,nan,TRUE,\n")
    df = read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    rows = [tuple(r) for r in df.orderBy("c").collect()]
    assert (None, 3.0, None, True, None) in rows and (2, None, "  y ", False, None) in rows


def test_json_array_and_lines(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"k": 1, "v": {"z": 2}}, {"k": 2, "v": None}]))
    df = load_table(spark, str(a))
    assert dict(df.dtypes)["v"] == "string" and df.count() == 2
    b = tmp_path / "b.json"
    b.write_text('{"k": 1}\n{"k": 3}\n')
    assert read_json(spark, str(b)).count() == 2
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "x.xlsx"))


def test_normalize_and_write_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["a"], True)], "i int, x double, arr array<string>, b boolean")
    n = normalize_types(df)
    assert dict(n.dtypes) == {"i": "int", "x": "double", "arr": "string", "b": "boolean"}
    assert n.first()["x"] is None
    out = str(tmp_path / "o")
    write_csv(df, out)
    back = read_csv(spark, out).first()
    assert back["arr"] == '["a"]' and back["x"] is None and back["b"] is True


def test_sample_table(spark, tmp_path):
    p = tmp_path / "flowers.csv"
    p.write_text("width,length,kind\n" + "1.5,2,a\n1.5,2,a\n1.5,2,a\n3.5,4,b\n\n")
    df = read_sample(spark, str(p))
    assert df.count() == 4 and df.dtypes == [("width", "double"), ("length", "bigint"), ("kind", "string")]
    assert df.count() - df.distinct().count() == 2


ODD = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, 'only "quotes"'), (4, "a,b"), (5, '"'), (6, "plain"), (7, 'x""y')]


def test_csv_cells_with_quotes_commas_and_line_ends(spark, tmp_path):
    out = str(tmp_path / "o")
    write_csv(spark.createDataFrame(ODD, "id int, s string"), out)
    back = read_csv(spark, out)
    assert dict(back.dtypes) == {"id": "bigint", "s": "string"}
    assert sorted(tuple(r) for r in back.collect()) == ODD
    import pandas as pd
    import glob
    frames = [pd.read_csv(f) for f in glob.glob(out + "/*.csv")]
    assert sorted(map(tuple, pd.concat(frames).itertuples(index=False))) == ODD


def test_csv_ragged_rows(spark, tmp_path):
    p = tmp_path / "short.csv"
    p.write_text('a,b,c\n1,2\n3,"x,y",5\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(p)).collect()) == [(1, "2", None), (3, "x,y", 5)]
    q = tmp_path / "long.csv"
    q.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="more cells"):
        read_csv(spark, str(q))


@pytest.mark.parametrize("text", ['[\n{"k": 1, "s": "a"},\n{"k": 2, "s": null}\n]', '[{"k": 1, "s": "a"}, {"k": 2, "s": null}]',
                                  '[\n  {\n    "k": 1,\n    "s": "a"\n  },\n  {"k": 2, "s": null}]', '{"k": 1, "s": "a"}\n{"k": 2, "s": null}\n',
                                  '{"k": {"0": 1, "1": 2}, "s": {"0": "a", "1": null}}', '{\n"k": {"0": 1, "1": 2},\n"s": {"0": "a"}\n}'])
def test_json_layouts(spark, tmp_path, text):
    p = tmp_path / "t.json"
    p.write_text(text)
    df = read_json(spark, str(p))
    assert sorted(df.columns) == ["k", "s"]
    assert sorted((r["k"], r["s"]) for r in df.collect()) == [(1, "a"), (2, None)]


def test_not_json(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text("hello\n")
    with pytest.raises(ValueError):
        read_json(spark, str(p))


def test_preview_by_key(spark):
    assert [r["id"] for r in preview(spark.range(50).repartition(4), 3, "id").collect()] == [0, 1, 2]


def one_task(df, path):
    """The bytes of the part that a single task writes."""
    df.coalesce(1).sortWithinPartitions("id").write.option("escape", '"').option("header", True).csv(path)
    (part,) = glob.glob(path + "/part-*")
    with open(part, "rb") as f:
        return f.read()


def test_one_csv_file_where_files_cannot_be_joined(spark, tmp_path, monkeypatch):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.onefile.link./in", f"file://{tmp_path}")
    df = spark.createDataFrame([(i, f"say \"{i}\",\nthen") for i in range(50)], "id int, note string").repartition(4)
    write_csv_file(df, "viewfs://onefile/in/t.csv", order_by="id")
    assert (tmp_path / "t.csv").read_bytes() == one_task(df, str(tmp_path / "one"))
    # a cluster whose shared folder is a mounted disk
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    monkeypatch.setattr("curata.session.checkpoint_root", lambda spark: f"file://{tmp_path}/shared")
    write_csv_file(df, str(tmp_path / "shared" / "t.csv"), order_by="id")
    assert (tmp_path / "shared" / "t.csv").read_bytes() == (tmp_path / "t.csv").read_bytes()
    with pytest.raises(ValueError, match="disk of one machine"):
        write_csv_file(df, str(tmp_path / "lost.csv"))


def test_one_csv_file_equals_that_of_one_task(spark, tmp_path):
    rows = [(10 * k + i, s, None if k % 5 else k / 3) for k in range(20) for i, s in ODD]
    df = spark.createDataFrame(rows, 'id int, `a "name", of b` string, x double').repartition(6)
    out = tmp_path / "t.csv"
    out.write_text("what was there")
    write_csv_file(df, str(out), order_by="id")
    assert out.read_bytes() == one_task(df, str(tmp_path / "one"))
    assert [p.name for p in tmp_path.iterdir() if "t.csv" in p.name and not p.name.endswith(".crc")] == ["t.csv"]
    back = read_csv(spark, str(out), position="at")
    assert [r["id"] for r in preview(back, 1000, "at").collect()] == [r[0] for r in rows]
    write_csv_file(back.where("id < 50"), str(out), order_by="at")  # the position itself is not written
    assert read_csv(spark, str(out)).columns == df.columns
    write_csv_file(df.limit(0), str(out))
    assert out.read_text() == 'id,"a ""name"", of b",x\n'
