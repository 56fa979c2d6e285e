"""Readers, type normalisation and writers."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles
from ..functions.exprs import nan_to_null, text_to_double, text_to_long
from ..session import materialize, scratch_path, shared_root
from .splits import csv_records, json_array_records, json_column_cells, with_columns

# Cell texts pandas reads as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

# Texts read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


def _q(name: str):
    return F.col(f"`{name}`")


def normalize_types(df: DataFrame) -> DataFrame:
    """Numeric and boolean columns stay; every other column becomes text
    (dates as ISO text, nested values as JSON); missing stays missing; float
    NaN becomes NULL. One projection, no job."""
    cols = []
    for f in df.schema.fields:
        c = _q(f.name)
        dt = f.dataType
        if roles.role_of(f) == "position":
            cols.append(c)
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            cols.append(nan_to_null(c).cast(dt).alias(f.name))
        elif isinstance(dt, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                             T.DecimalType, T.StringType)):
            cols.append(c)
        elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(c).alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    return df.select(*cols)


def _position(name: str, file: Column, block: Column, row: Column) -> Column:
    """Where a row stands: its file, the start of its split, and a number that
    grows within the split. These compare in load order, whichever tasks read
    the splits, and need neither a shuffle nor a second pass."""
    return F.struct(file.alias("file"), block.cast("long").alias("block"), row.cast("long").alias("row")).alias(name, metadata=roles.POSITION)


def _scan_position(df: DataFrame, name: str) -> Column:
    """The position of a row of a file scan: its tasks number rows as they read them."""
    meta = df.metadataColumn("_metadata")
    return _position(name, meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id())


_CORRUPT = "_curata_corrupt"
#: A comma outside quotes.
_CELL_END = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _csv(spark: SparkSession, schema: str | None = None, multi_line: bool = False):
    """Cells as text; a quote inside a quoted cell is doubled."""
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT))
    return reader.schema(schema) if schema else reader


def _text_schema(names: list[str]) -> str:
    """All cells as text; the reserved column holds rows whose number of cells
    is not the header's."""
    return ", ".join([f"`{c.replace('`', '``')}` string" for c in names] + [f"{_CORRUPT} string"])


def _csv_of_records(spark: SparkSession, path: str, position: str | None) -> tuple[list[str], DataFrame]:
    """Column names and cells of files whose cells hold line ends."""
    records = materialize(csv_records(spark, path).where(F.trim("text") != ""), cut_lineage=True)
    starts = records.groupBy("file").agg(F.min(F.struct("block", "seq")).alias("at"))
    headers = records.join(starts, "file").where((F.col("block") == F.col("at.block")) & (F.col("seq") == F.col("at.seq"))).select("file", "block", "seq", "text")
    first = headers.orderBy("file").select("text").first()
    if first is None:
        return [], records
    header = spark.createDataFrame([(first["text"],)], "value string")
    # the names as the CSV reader makes them
    path = scratch_path(spark, "header")
    header.coalesce(1).write.text(path)
    names = _csv(spark, multi_line=True).csv(path).columns
    rows = records.join(headers.select("file", "block", "seq"), ["file", "block", "seq"], "left_anti")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    at = [_position(position, F.col("file"), F.col("block"), F.col("seq"))] if position else []
    return names, rows.select(F.from_csv("text", _text_schema(names), options).alias("r"), *at).select("r.*", *map(_q, [position] if position else []))


def read_csv(spark: SparkSession, path: str, infer: bool = True, position: str | None = None) -> DataFrame:
    """CSV with a header. Cells are read as text, the pandas missing tokens
    become NULL, then each column takes the narrowest of bigint / double /
    boolean that every non-missing cell casts to (all-or-nothing), else stays
    text. Inference is one aggregate pass for all columns.

    A line with an odd number of quotes means that a cell may hold a line end;
    only then are the splits cut at the true ends of records first (see
    ``splits``), still by many tasks. A row with fewer cells than the header is
    filled with missing cells; one with more raises ``ValueError``.

    ``position`` names one more column that holds where a row was loaded from
    (file, split, row in it): ordering by it is the order of the file. Filters
    above the column are not pushed into the scan, so it is only made on demand.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = spark.read.text(path).agg(F.count_if(quotes % 2 == 1)).first()[0]
    if broken:
        names, raw = _csv_of_records(spark, path, position)
    else:
        names = _csv(spark).csv(path).columns
        raw = _csv(spark, _text_schema(names)).csv(path) if names else None
        if position and names:
            raw = raw.select("*", _scan_position(raw, position))
    if position in names:
        raise ValueError(f"{path} has a column {position!r} already")
    at = [_q(position)] if position else []
    if not names:
        return spark.createDataFrame([], T.StructType())
    tokens = list(NA_TOKENS)
    nulled = raw.select(*[
        F.when(_q(c).isin(tokens) | _q(c).isNull(), F.lit(None).cast("string"))
        .otherwise(_q(c)).alias(c) for c in names], _CORRUPT, *at)
    cells = F.size(F.split(_CORRUPT, _CELL_END, -1))
    aggs = [F.count_if(F.col(_CORRUPT).isNotNull() & (cells > len(names))).alias("ragged")]
    for i, c in enumerate(names):
        v = _q(c)
        aggs += [F.count_if(v.isNotNull() & text_to_long(v).isNull()).alias(f"l{i}"),
                 F.count_if(v.isNotNull() & text_to_double(v).isNull()).alias(f"d{i}"),
                 F.count_if(v.isNotNull() & ~v.isin(list(TRUE_TOKENS + FALSE_TOKENS))).alias(f"b{i}"),
                 F.count(v).alias(f"n{i}")]
    facts = nulled.agg(*aggs).first()
    if facts["ragged"]:
        raise ValueError(f"{facts['ragged']} row(s) of {path} have more cells than the header")
    out = []
    for i, c in enumerate(names):
        v = _q(c)
        if not infer or facts[f"n{i}"] == 0:
            out.append(v)
        elif facts[f"l{i}"] == 0:
            out.append(text_to_long(v).alias(c))
        elif facts[f"d{i}"] == 0:
            out.append(nan_to_null(text_to_double(v)).alias(c))
        elif facts[f"b{i}"] == 0:
            out.append(v.isin(list(TRUE_TOKENS)).alias(c))
        else:
            out.append(v)
    return nulled.select(*out, *at)


def _json_lines(spark: SparkSession, rows: DataFrame, position: str | None) -> DataFrame:
    """JSON texts, one a row, written and read as lines; with a position, each
    line also carries the file, block and seq of its record."""
    path = scratch_path(spark, "records")
    if position:
        at = F.to_json(F.struct("file", "block", "seq"))
        rows = rows.select(F.concat(F.lit('{"at":'), at, F.lit(',"record":'), "text", F.lit("}")).alias("text"))
    rows.select("text").write.text(path)
    df = spark.read.option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    if not position or _CORRUPT in df.columns:
        return df
    if "record" not in df.columns:
        return df.select()
    return df.select("record.*", _position(position, F.col("at.file"), F.col("at.block"), F.col("at.seq")))


def _by_columns(spark: SparkSession, path: str, position: str | None) -> DataFrame | None:
    """The table of a document ``{"column": {"row": value}}``, if it is one:
    cells are read by many tasks and shuffled by the row's label."""
    cells = json_column_cells(spark, path)
    if cells is None:
        return None
    cells = materialize(cells, cut_lineage=True)
    if not cells.where("odd").isEmpty():
        return None
    cells = with_columns(cells)
    names = [json.loads(r["column"]) for r in cells.select("column").distinct().collect()]
    if not names:
        return None
    entry = F.concat("column", F.lit(":"), "value")
    first = F.min(F.struct("block", "seq"))  # a row stands where its label is read first
    rows = cells.where("label is not null").groupBy("label").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("text"),
                                                                  first.alias("at")).select("text", F.lit(path).alias("file"), "at.*")
    df = _json_lines(spark, rows, position)
    at = [_q(position)] if position and position in df.columns else []
    return df.select(*(_q(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in sorted(names)), *at)


def read_json(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """JSON lines, an array of records (on one line or many), or a document by
    columns, ``{"column": {"row": value}}``. All are read by many tasks; what
    is none of these, but JSON, by one task a file. Text that is not JSON
    raises ``ValueError``. ``position`` as for :func:`read_csv`; a row of a
    document by columns stands where its label is read first."""
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    start = spark.read.text(path).where(F.trim("value") != "")
    first = start.select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    df = None
    if first and first["c"] == "[":
        records = json_array_records(spark, path)
        df = None if records is None else _json_lines(spark, records, position)
    elif first:
        # one line, or a first line that doesn't close: one document a file
        ends = start.select(F.length(F.rtrim("value")).alias("n"), F.substring(F.rtrim("value"), -1, 1).alias("last")).limit(2).collect()
        if len(ends) == 1 or ends[0]["last"] != "}" or ends[0]["n"] == 1:
            df = _by_columns(spark, path, position)
        if df is None:
            df = spark.read.options(**options).json(path)
    if df is None or _CORRUPT in df.columns:
        df = spark.read.options(**options).option("multiLine", True).json(path)
    if _CORRUPT in df.columns:
        raise ValueError(f"{path} is not JSON")
    if position and df.columns and not any(roles.role_of(f) == "position" for f in df.schema.fields):
        df = df.select("*", _scan_position(df, position))
    if df.columns.count(position) > 1:
        raise ValueError(f"{path} has a column {position!r} already")
    return df


def read_parquet(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if not position:
        return df
    meta = df.metadataColumn("_metadata")
    return df.select("*", _position(position, meta["file_path"], F.lit(0), meta["row_index"]))


def load_table(spark: SparkSession, path: str, normalize: bool = True, position: str | None = None) -> DataFrame:
    """Pick the reader by suffix (case-insensitive): .csv, .json, .parquet.
    Unknown suffixes raise (Excel is not supported: convert it to CSV).
    ``position`` as for :func:`read_csv`."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = read_csv(spark, path, position=position)
    elif low.endswith(".json") or low.endswith(".jsonl"):
        df = read_json(spark, path, position)
    elif low.endswith(".parquet"):
        df = read_parquet(spark, path, position)
    elif low.endswith(".xlsx") or low.endswith(".xls"):
        raise ValueError("Excel files are not supported; save the sheet as CSV")
    else:
        raise ValueError(f"unknown file type: {path}")
    return normalize_types(df) if normalize else df


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The sample table (a CSV with a header) through the normal CSV path."""
    return normalize_types(read_csv(spark, path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, UTF-8, no index; quotes inside cells are doubled;
    nested values written as JSON."""
    flat = normalize_types(df)
    (flat.write.mode(mode).option("header", True).option("encoding", "UTF-8")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_csv_file(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """One CSV file with one header, written by many tasks: headerless parts,
    in order (of ``order_by``, by range, if given; a position from a reader is
    not written), are joined by the file system, and the file appears under its
    name when it is whole. A file there before is replaced.

    HDFS joins parts by their blocks, without moving bytes. On other file
    systems the bytes are copied, 1 MB at a time, through the driver. On a
    cluster a ``file:`` path must lie below ``spark.checkpoint.dir``, which the
    driver shares with the tasks: another raises ``ValueError`` before anything
    is written.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        root = shared_root(spark)
        below = root and files.makeQualified(target).toString().startswith(hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop.fs.Path(root)).toString() + "/")
        if not below:
            raise ValueError(f"{path} is on a disk of one machine; write below spark.checkpoint.dir, or a folder of parts with write_csv")
    joins = files.hasPathCapability(target, "fs.capability.paths.concat")
    if order_by:
        df = df.orderBy(_q(order_by))
    df = df.drop(*(f.name for f in df.schema.fields if roles.role_of(f) == "position"))
    flat = normalize_types(df)
    # beside the target: the same file system, where the last step is a rename
    folder = hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    try:
        options = {"encoding": "UTF-8", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        flat.write.options(**options, header=False).csv(folder.toString())
        parts = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()]
        parts.sort(key=lambda p: p.getName())
        whole = hadoop.fs.Path(folder, "whole")
        out = files.create(whole, True)
        out.write(bytearray((",".join(map(_header_cell, flat.columns)) + "\n").encode()))
        if not joins:
            for p in parts:
                part = files.open(p)
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
        out.close()
        if parts and joins:
            sources = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
            for i, p in enumerate(parts):
                sources[i] = p
            files.concat(whole, sources)
        files.delete(target, False)
        files.rename(whole, target)
    finally:
        files.delete(folder, True)


def _header_cell(name: str) -> str:
    """A column name as the CSV writer puts it."""
    quoted = any(c in name for c in ',"\r\n') or not name
    return '"' + name.replace('"', '""') + '"' if quoted else name


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON with one array of records a file, a record a line."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def array(batches):
        last = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                texts = ["["] * (last is None) + [f"{r}," for r in ([last] if last else []) + rows[:-1]]
                last = rows[-1]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if last is None else [last, "]"])], ["value"])

    lines.mapInArrow(array, "value string").write.mode(mode).text(path)


def preview(df: DataFrame, n: int = 5, key: str | None = None) -> DataFrame:
    """The first rows by ``key``; without one any n rows, for Spark keeps no
    order. With the position column of a reader as the key these are the first
    rows of the file, and the position itself is not shown; each task keeps n rows."""
    if not key:
        return df.limit(n)
    first = df.orderBy(_q(key)).limit(n)
    return first.drop(key) if roles.role_of(df.schema[key]) == "position" else first


def number_rows(df: DataFrame, position: str, name: str) -> DataFrame:
    """Rows numbered from 0 in load order, in place of their position. A count a
    split gives the number at which each split starts; rows are ranked within
    their own split, so no task holds more than a split. The table is written
    once first, so that both see the same splits if a task is run again."""
    at = df.select("*", _q(position).getField("file").alias("_file"), _q(position).getField("block").alias("_block"))
    at = materialize(at, cut_lineage=True)
    splits = at.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    starts = splits.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy(_q(position))) - 1
    numbered = at.withColumn("_row", own).join(starts, ["_file", "_block"])
    return numbered.select(*(_q(c) for c in df.columns if c != position), (F.col("_start") + F.col("_row")).alias(name))
