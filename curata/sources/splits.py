"""Records that one line does not hold, read by many tasks.

A file is read in pieces that end at one byte (a line end for CSV, a brace or
a comma for JSON), so every split has its own task. Whether a piece starts
inside a quoted cell or a string, and how deep in brackets, depends on all that
stands before it. So a first pass turns each split into a small function from
the state at its start to the state at its end (for either state of the
quotes); composing these in file order gives the state at each split's start.
The driver does that: it holds a few numbers a split, as it does to schedule
them. A second pass cuts each split at the true ends of records. What is left
over at a border, at most two fragments a split, is put together by a window
over the splits of a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of rows: a whole record; one that goes on behind the split; what goes on from splits before.
WHOLE, OPEN, LEAD = 0, 1, 2

_ROWS = "file string, block long, kind int, seq long, depth long, text string"
_QUOTED = r'"(?:[^"]|"")*+"[^,]*+'
_CLOSED = re.compile(rf'(?:(?:{_QUOTED}|(?!")[^,]*+),)*+(?:{_QUOTED}|(?!")[^,]*+)', re.S)
_CELL_REST = re.compile(r'(?:[^"]|"")*+"[^,]*+', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """file, block (start of the split) and value of each piece, in reading order."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def cells_end(line: str, inside: bool) -> bool:
    """Whether a line of CSV ends inside a quoted cell. A quote opens a cell
    only at its start; after the closing quote a cell goes on to the comma."""
    if '"' not in line:
        return inside
    if inside:
        rest = _CELL_REST.match(line)
        if rest is None:
            return True
        if rest.end() == len(line):
            return False
        line = line[rest.end() + 1:]
    return _CLOSED.fullmatch(line) is None


def brackets(piece: str, inside: bool) -> tuple[bool, int, str]:
    """For a piece of JSON: whether it ends inside a string, the change of
    depth, and the piece without its strings."""
    if inside:
        rest = _STRING_REST.match(piece)
        if rest is None:
            return True, 0, ""
        piece = piece[rest.end():]
    bare = _STRING.sub("", piece) if '"' in piece else piece
    at = bare.find('"')
    if at >= 0:
        bare = bare[:at]
    return at >= 0, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]"), bare


def _splits(batches) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """Key and pieces of each split, batch by batch, and whether it starts there."""
    last = None
    for batch in batches:
        files, blocks, values = (batch.column(i) for i in range(3))
        key = [(f, b) for f, b in zip(files.to_pylist(), blocks.to_pylist(), strict=True)]
        a = 0
        while a < len(key):
            b = a
            while b < len(key) and key[b] == key[a]:
                b += 1
            yield key[a], values.slice(a, b - a).to_pylist(), key[a] != last
            last = key[a]
            a = b


def split_states(rows: DataFrame, step: Callable[[str, bool], tuple[bool, int]]) -> dict[tuple[str, int], tuple[bool, int]]:
    """State (inside quotes, depth) at the start of each split, and under block
    -1 that at the end of each file."""

    def scan(batches):
        own: dict[tuple[str, int], list] = {}
        for key, values, _ in _splits(batches):
            state = own.setdefault(key, [False, 0, True, 0])
            for value in values:
                for i in (0, 2):
                    state[i], change = step(value, state[i])
                    state[i + 1] += change
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own]), pa.array([k[1] for k in own], pa.int64()),
                                              *(pa.array([v[i] for v in own.values()], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.bool_(), pa.int64())))],
                                             ["file", "block", "out_end", "out_depth", "in_end", "in_depth"])

    found = rows.mapInArrow(scan, "file string, block long, out_end boolean, out_depth long, in_end boolean, in_depth long").collect()
    states, inside, depth, file = {}, False, 0, None
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        states[file, r["block"]] = (inside, depth)
        inside, depth = (r["in_end"], depth + r["in_depth"]) if inside else (r["out_end"], depth + r["out_depth"])
        states[file, -1] = (inside, depth)
    return states


def _cut(rows: DataFrame, states: dict, closes, end: str) -> DataFrame:
    """Records of the pieces: ``closes(piece, inside, depth)`` gives the state
    after a piece and whether a record ends with it."""
    sent = rows.sparkSession.sparkContext.broadcast(states)  # one entry a split

    def scan(batches):
        out: list[tuple] = []
        held: list[str] = []
        key, seq, lead, begun = None, 0, False, 0
        inside, depth = False, 0

        def flush():
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["file", "block", "kind", "seq", "depth", "text"])
            out.clear()
            return batch

        def leave():
            if held:
                out.append((*key, LEAD if lead else OPEN, seq, begun, end.join(held)))
                held.clear()

        for new, values, begins in _splits(batches):
            if begins:
                if key is not None:
                    leave()
                key, seq = new, 0
                inside, depth = sent.value[key]
                begun, lead = depth, closes.within(inside, depth)
            for value in values:
                held.append(value)
                inside, depth, done = closes(value, inside, depth)
                if done:
                    out.append((*key, LEAD if lead else WHOLE, seq, begun, end.join(held)))
                    held.clear()
                    begun, lead, seq = depth, False, seq + 1
            if len(out) >= 5000:
                yield flush()
        if key is not None:
            leave()
        if out:
            yield flush()

    return rows.mapInArrow(scan, _ROWS)


def _joined(cut: DataFrame, end: str) -> DataFrame:
    """Whole records (file, block, seq, depth at the start, text): the fragments
    of a record are those from an open one to the next."""
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))  # a lead stands before an open one
    parts = cut.where(F.col("kind") != WHOLE).withColumn("record", F.count_if(F.col("kind") == OPEN).over(order))
    own = F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("k"), "seq", "depth", "text")))
    parts = parts.groupBy("file", "record").agg(own.alias("own"))
    parts = parts.select("file", *(F.col("own")[0][c].alias(c) for c in ("block", "seq", "depth")), F.array_join(F.transform("own", lambda x: x["text"]), end).alias("text"))
    return cut.where(F.col("kind") == WHOLE).select("file", "block", "seq", "depth", "text").unionByName(parts)


class _Cells:
    def __call__(self, line, inside, depth):
        inside = cells_end(line, inside)
        return inside, 0, not inside

    def within(self, inside, depth):
        return inside


class _Depth:
    """Records that end where the depth falls back to ``least`` with a brace,
    or at a comma at most ``least`` deep."""

    def __init__(self, least: int, end: str):
        self.least, self.end = least, end

    def __call__(self, piece, inside, depth):
        inside, change, _ = brackets(piece, inside)
        depth += change
        if self.end == "}":
            depth -= not inside
            return inside, depth, not inside and depth == self.least
        return inside, depth, not inside and depth <= self.least

    def within(self, inside, depth):
        return inside or depth > self.least


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq and text of each CSV record; seq 0 of block 0 is the
    first of its file. A carriage return before the line end is part of it
    unless a cell holds it."""
    rows = pieces(spark, path, "\n")
    states = split_states(rows, lambda line, inside: (cells_end(line, inside), 0))
    found = _joined(_cut(rows, states, _Cells(), "\n"), "\n")
    return found.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _json_step(end: str):
    def step(piece, inside):
        inside, change, _ = brackets(piece, inside)
        return inside, change - (end == "}" and not inside)

    return step


def json_array_records(spark: SparkSession, path: str) -> DataFrame | None:
    """text of each record of files that hold an array of objects each; None
    if something else stands in an array."""
    rows = pieces(spark, path, "}")
    states = split_states(rows, _json_step("}"))
    for (_, block), (inside, depth) in states.items():
        # the text behind the last brace is read as if one more followed
        if block == -1 and (inside or depth not in (-1, 0)):
            return None
    found = _joined(_cut(rows, states, _Depth(1, "}"), "}"), "}")
    # what stands before a record, and behind the last
    found = found.withColumn("text", F.regexp_replace("text", r"^[\s\[,]+", "")).where(~F.col("text").rlike(r"^[\s\]]*$"))
    found = found.select("file", "block", "seq", F.regexp_replace(F.concat("text", F.lit("}")), "[\r\n]+", " ").alias("text"))
    return found if found.where(~F.col("text").startswith("{")).isEmpty() else None


_KEY = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.S)


def json_column_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """column, label and value (JSON texts) of the cells of one document
    ``{"column": {"label": value}}``, with a null label for a column without
    cells; None if it is something else."""
    rows = pieces(spark, path, ",")
    states = split_states(rows, _json_step(","))
    ends = [state for (_, block), state in states.items() if block == -1]
    if ends != [(False, 0)]:
        return None
    found = _joined(_cut(rows, states, _Depth(2, ","), ","), ",")

    def cells(batches):
        for batch in batches:
            out: list[tuple] = []
            for block, seq, depth, text in zip(*(batch.column(c).to_pylist() for c in ("block", "seq", "depth", "text")), strict=True):
                text, column, odd = text.strip(), None, False
                if depth == 0:
                    odd, text = text[:1] != "{", text[1:].strip()
                if depth < 2 and not odd:
                    key = _KEY.match(text)
                    odd = key is None or text[key.end():key.end() + 1] != "{"
                    if not odd:
                        column, text = key[1], text[key.end() + 1:]
                for _ in range(-brackets(text, False)[1]):  # the ends of the column and the document
                    text = text.rstrip()[:-1]
                key = _KEY.match(text)
                out.append((block, seq, column, key and key[1], re.sub("[\r\n]+", " ", text[key.end():].strip()) if key else None,
                            odd or (key is None and bool(text.strip()))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["block", "seq", "column", "label", "value", "odd"])

    return found.mapInArrow(cells, "block long, seq long, column string, label string, value string, odd boolean")


def with_columns(cells: DataFrame) -> DataFrame:
    """The cells with the column that each belongs to: the last that began
    before it, in its split or in one before."""
    began = cells.where("column is not null").groupBy("block").agg(F.max_by("column", "seq").alias("last"))
    blocks = cells.select("block").distinct().join(began, "block", "left")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    blocks = blocks.select("block", F.last("last", ignorenulls=True).over(before).alias("before"))
    own = F.last("column", ignorenulls=True).over(Window.partitionBy("block").orderBy("seq"))
    filled = cells.withColumn("column", own).join(blocks, "block")
    return filled.select(F.coalesce("column", "before").alias("column"), "label", "value", "block", "seq")
