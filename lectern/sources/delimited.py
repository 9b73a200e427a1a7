"""Delimited text files as a data source that cuts files in splits, whatever stands in quotes.

A quotation mark anywhere in a field turns quoting on or off, two inside quotes
are one mark, and a line ends at CR, LF or both where no quotes are open. So
whether a split begins inside quotes depends on all that stands before it: a
first pass counts the marks of every split, a running sum tells the state at its
start, and the second pass cuts all splits side by side. A split owns the rows
that begin in it. Rows whose fields are all empty are left out, and so is a byte
order mark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COUNTS = "path string, start long, marks long"
ROWS = "path string, at long, fields array<string>"
SPLIT = 64 << 20
#: Bytes that are read at once behind the end of a split, to finish its last row.
MORE = 1 << 16
MARK, BOM = ord('"'), b"\xef\xbb\xbf"


def unquoted(field: str) -> str:
    """A field without its quotation marks: each turns quoting on or off, but two inside quotes are one mark."""
    if '"' not in field:
        return field
    parts = field.split('"')
    out, quoted, k = [parts[0]], False, 1
    while k < len(parts):
        if quoted and not parts[k] and k + 1 < len(parts):
            out.append('"' + parts[k + 1])
            k += 2
        else:
            quoted = not quoted
            out.append(parts[k])
            k += 1
    return "".join(out)


def line_ends(data: np.ndarray, inside: bool) -> np.ndarray:
    """Where lines end in bytes that begin inside quotes or not."""
    open_ = (np.cumsum(data == MARK) + inside) & 1
    return np.flatnonzero(((data == 10) | (data == 13)) & (open_ == 0))


def cut_rows(data: np.ndarray, sep: int) -> Iterator[tuple[int, list[str]]]:
    """(place, fields) of the rows of bytes that begin where a row does. Rows without any character go."""
    open_ = np.cumsum(data == MARK) & 1
    free = open_ == 0
    ends = np.append(np.flatnonzero(((data == 10) | (data == 13)) & free), len(data))
    seps = np.flatnonzero((data == sep) & free)
    raw = data.tobytes()
    at = k = 0
    for end in ends.tolist():
        if end > at:
            fields, a = [], at
            while k < len(seps) and seps[k] < end:
                fields.append(raw[a : seps[k]])
                a, k = int(seps[k]) + 1, k + 1
            fields.append(raw[a:end])
            row = [unquoted(f.decode("utf-8", "replace")) for f in fields]
            if any(row):
                yield at, row
        at = end + 1


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool):
        self.path, self.start, self.end, self.inside = path, start, end, inside


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sep = ord(options.get("sep", ","))
        self.size = int(options.get("splitbytes", SPLIT))
        self.counting = options.get("count") == "true"
        self.inside = {tuple(x) for x in json.loads(options.get("inside", "[]"))}

    def partitions(self) -> list[Split]:
        files, at = file_system(self.path)
        info = files.get_file_info(at)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            out += [Split(f.path, a, min(f.size, a + self.size), (f.path, a) in self.inside) for a in range(0, f.size, self.size)]
        return out or [Split("", 0, 0, False)]

    def read(self, split: Split) -> Iterator[tuple]:
        if not split.path:
            return
        with file_system(self.path)[0].open_input_file(split.path) as f:
            if self.counting:
                yield split.path, split.start, int((self._bytes(f, split.start, split.end) == MARK).sum())
                return
            yield from self._rows(f, split)

    def _bytes(self, f, start: int, end: int) -> np.ndarray:
        f.seek(start)
        return np.frombuffer(f.read(end - start), np.uint8)

    def _rows(self, f, split: Split) -> Iterator[tuple]:
        """The rows that begin in the split. Where the byte before it is no free line end, the first of them begins behind the first one."""
        data, begin = self._bytes(f, split.start, split.end), 0
        if split.start:
            before = self._bytes(f, split.start - 1, split.start)
            if split.inside or before[0] not in (10, 13):
                ends = line_ends(data, split.inside)
                if not len(ends):
                    return
                begin = int(ends[0]) + 1
        data = data[begin:]
        if not len(data):
            return
        inside = bool((data == MARK).sum() & 1)
        if inside or data[-1] not in (10, 13):  # the last row goes on
            pieces, at, size = [data], split.end, f.size()
            while at < size:
                more = self._bytes(f, at, min(size, at + MORE))
                ends = line_ends(more, inside)
                pieces.append(more[: ends[0]] if len(ends) else more)
                if len(ends):
                    break
                inside ^= bool((more == MARK).sum() & 1)
                at += len(more)
            data = np.concatenate(pieces)
        if split.start == 0 and data[: len(BOM)].tobytes() == BOM:
            data, begin = data[len(BOM) :], len(BOM)
        for place, fields in cut_rows(data, self.sep):
            yield split.path, split.start + begin + place, fields


class DelimitedSource(DataSource):
    """Format ``delimited``: options ``path``, ``sep``, ``splitbytes``; ``count`` asks for the marks of the splits, and ``inside`` lists the splits that begin inside quotes."""

    @classmethod
    def name(cls) -> str:
        return "delimited"

    def schema(self) -> str:
        return COUNTS if self.options.get("count") == "true" else ROWS

    def reader(self, schema) -> DelimitedReader:
        return DelimitedReader(dict(self.options))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", split_bytes: int = SPLIT) -> DataFrame:
    """(path, at, fields) of each row of a file or of the files under a folder, ``at`` being the byte where it begins.

    Files may be anywhere that Arrow's file systems reach. Two passes: the first
    gives a number for each split, which is all that the driver sees. A row longer
    than a split is read by the split it begins in; memory follows the longest row.
    """
    spark.dataSource.register(DelimitedSource)
    source = spark.read.format("delimited").option("path", path).option("sep", sep).option("splitbytes", split_bytes)
    before = F.sum("marks").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    counts = source.option("count", "true").load().select("path", "start", before.alias("before"))
    inside = [[r["path"], r["start"]] for r in counts.filter(F.col("before") % 2 == 1).select("path", "start").collect()]
    return source.option("count", "false").option("inside", json.dumps(inside)).load()


def by_header(rows: DataFrame) -> DataFrame:
    """The rows as columns named by each file's first row, which must be the same in all files; missing fields are null. An empty table has no columns."""
    heads = rows.groupBy("path").agg(F.min_by("fields", "at").alias("head"), F.min("at").alias("first"))
    names = [r["head"] for r in heads.select("head").distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError("files have different headers")
    body = rows.join(heads.select("path", "first"), "path").filter("at > first")
    return body.select(*[F.get("fields", F.lit(k)).alias(name) for k, name in enumerate(names[0] if names else [])])


def plain_rows(raw: bytes, sep: str = ",") -> list[list[str]]:
    """The rows of some bytes, read in one go."""
    return [row for _, row in cut_rows(np.frombuffer(raw.removeprefix(BOM), np.uint8), ord(sep))]


def delimited_text(rows: DataFrame, sep: str = ",") -> DataFrame:
    """One text column with each row's columns as a line that ``read_delimited`` gives back: quoted where a mark, a separator or a line end stands in them, nulls empty."""
    def field(c: str):
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(t.rlike(f'["\\r\\n{sep}]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return rows.select(F.concat_ws(sep, *map(field, rows.columns)).alias("value"))

