"""Load order: positions from the readers, and what uses them."""

import json
import random

import pandas as pd
import pytest

from curata.operators import plotdata
from curata.operators.features import make_one_hot_rule
from curata.operators.fit import fit_one_hot
from curata.sources import load_table, number_rows, preview, read_csv, read_json


@pytest.fixture
def small_splits(spark):
    """Files of a few hundred bytes are read by several tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(df):
    rows = sorted(df.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(len(rows)))
    return rows


@pytest.mark.parametrize("broken", [False, True])
def test_csv_in_file_order(small_splits, tmp_path, broken):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 60)
    frame = pd.DataFrame({"id": ids, "s": [f"v{i}" + ("\nnext, line" if broken and i % 3 == 0 else "") for i in ids]})
    frame.to_csv(tmp_path / "t.csv", index=False)
    df = load_table(small_splits, str(tmp_path / "t.csv"), position="at")
    assert df.columns == ["id", "s", "at"] and df.rdd.getNumPartitions() > 1
    assert [tuple(r) for r in preview(df, 5, "at").collect()] == list(frame.head().itertuples(index=False, name=None))
    assert [r["id"] for r in numbered(number_rows(df, "at", "row"))] == ids
    kept = number_rows(df.where("id % 2 = 0"), "at", "row")
    assert [r["id"] for r in numbered(kept)] == [i for i in ids if i % 2 == 0]


@pytest.mark.parametrize("layout", ["lines", "array", "columns", "indented"])
def test_json_in_file_order(small_splits, tmp_path, layout):
    ids = random.Random(5).sample(range(100), 30)
    rows = [{"id": i, "s": f"v{i}"} for i in ids]
    p = tmp_path / "t.json"
    if layout == "lines":
        p.write_text("\n".join(map(json.dumps, rows)))
    elif layout == "columns":
        p.write_text(json.dumps({c: {f"r{i}": r[c] for i, r in enumerate(rows)} for c in ("id", "s")}))
    else:
        p.write_text(json.dumps(rows, indent=2 if layout == "indented" else None))
    df = load_table(small_splits, str(p), position="at")
    assert sorted(df.columns) == ["at", "id", "s"]
    assert [r["id"] for r in numbered(number_rows(df, "at", "row"))] == ids
    assert [r["id"] for r in preview(df, 4, "at").collect()] == ids[:4]


def test_empty_files_and_a_column_of_that_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    df = read_csv(spark, str(tmp_path / "t.csv"), position="at")
    assert df.columns == ["a", "b", "at"] and preview(df, 5, "at").collect() == [] and number_rows(df, "at", "n").collect() == []
    (tmp_path / "u.csv").write_text("at,b\n1,2\n")
    with pytest.raises(ValueError, match="already"):
        read_csv(spark, str(tmp_path / "u.csv"), position="at")
    for i, text in enumerate(['{"at": 1}\n', '[{"at": 1}]']):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(ValueError, match="already"):
            read_json(spark, str(tmp_path / f"{i}.json"), position="at")


def test_one_hot_columns_by_first_appearance(small_splits, tmp_path):
    frame = pd.DataFrame({"k": ["pear", None, "fig", "pear", "apple", "fig"] * 5, "n": [2.5, 1.5, 2.5, None, 0.5, 1.5] * 5})
    frame.to_csv(tmp_path / "t.csv", index=False)
    df = read_csv(small_splits, str(tmp_path / "t.csv"), position="at")
    for c in ("k", "n"):
        rule = make_one_hot_rule(df, c, order_by="at")
        assert list(rule.levels) == list(frame[c].dropna().unique())
    model = fit_one_hot(df, ["k"], order_by="at")
    assert [c for c in model.transform(df).columns if c.startswith("k_")] == ["k_pear", "k_fig", "k_apple"]
    assert list(make_one_hot_rule(df, "k").levels) == ["apple", "fig", "pear"]


def test_dates_by_the_first_cells(small_splits, tmp_path):
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    late = ["no"] * 50 + ["2024-01-02"] * 350
    early = [None] * 10 + ["2024-01-02"] * 200 + ["no"] * 190
    pd.DataFrame({"late": late, "early": early, "none": [None] * 400}).to_csv(tmp_path / "t.csv", index=False)
    df = read_csv(small_splits, str(tmp_path / "t.csv"), position="at")
    assert plotdata.is_datetime_like(df, "late") and not plotdata.is_datetime_like(df, "late", order_by="at")
    assert not plotdata.is_datetime_like(df, "early") and plotdata.is_datetime_like(df, "early", order_by="at")
    assert not plotdata.is_datetime_like(df, "none", order_by="at")
    rows = {r["column"]: (r["non_missing"], r["parsed"], r["is_datetime"]) for r in plotdata.datetime_report(df, order_by="at").collect()}
    assert rows == {"late": (200, 150, False), "early": (200, 200, True), "none": (0, 0, False)}
    assert plotdata.datetime_columns(df, order_by="at") == ["early"]
