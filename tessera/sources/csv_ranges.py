"""CSV files of any size, read in ranges although quoted fields may hold line breaks.

The text source splits a file into ranges of lines. Whether a range begins
inside a quoted field is not known to its task, so a first pass runs each
range's quoted lines under both starting states and keeps the two end states.
A prefix scan over these small functions gives the true state of each range;
the second pass cuts its lines into records. Lines that end a record begun in an
earlier range are sent, with the beginning, to one group for each such record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import pin_file_ranges, stage

_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"', "lineSep": "\n"}
_RECORDS = "range int, line long, part int, record string"
_UNSEEN = "a range of the file was not there when the ranges were read first; are settings of file splits changing?"


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open behind `line`, if one was or was not before it.

    A quote opens a field only at its beginning; two in a row inside it stand for one.
    """
    at = 0
    if not quoted:
        if not line.startswith('"'):
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while True:
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(',"', at + 1)
        if at < 0:
            return False
        at += 2


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, file, value): lines with the range that they are read in."""
    pin_file_ranges(spark)
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_name").alias("file"), "value")


def _range_ends(lines: DataFrame) -> DataFrame:
    """(path, start, file, head, plain, inner, closes), one row for each range.

    `plain` and `inner` tell whether quotes are open at its end if they are
    closed or open at its beginning, `closes` whether open ones are ever
    closed. `head` is the first line of the file. Lines without a quote leave
    all that as it is and stay in the scan.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(place, ends, closes):
            return pa.RecordBatch.from_pylist([dict(
                path=place[0], start=place[1], plain=ends[0], inner=ends[1], closes=closes)])

        place, ends, closes = None, (False, True), False
        for batch in batches:
            for path, start, line in zip(*[batch.column(n).to_pylist() for n in ("path", "start", "value")]):
                if (path, start) != place:
                    if place:
                        yield row(place, ends, closes)
                    place, ends, closes = (path, start), (False, True), False
                ends = ends_quoted(line, ends[0]), ends_quoted(line, ends[1])
                closes = closes or not ends[1]
        if place:
            yield row(place, ends, closes)

    quoted = lines.where(F.col("value").contains('"')).select("path", "start", "value")
    ends = quoted.mapInArrow(run, "path string, start long, plain boolean, inner boolean, closes boolean")
    first = F.when((F.col("start") == 0) & ~F.col("value").isin("", "\r"), F.col("value"))
    every = lines.groupBy("path", "start").agg(
        F.first("file").alias("file"), F.first(first, ignorenulls=True).alias("head"))
    return every.join(ends, ["path", "start"], "left").select(
        "path", "start", "file", "head", *[F.coalesce(n, F.lit(n == "inner")).alias(n) for n in ("plain", "inner", "closes")])


def _range_states(ends: DataFrame) -> DataFrame:
    """(range, path, start, file, head, quoted, owner, torn): the ranges in order.

    `quoted` tells whether a range begins inside quotes, `owner` in which
    range the record that is open there began, `torn` whether it holds parts of such records.

    A range either sets the state, keeps it or turns it. The state behind any
    number of ranges is what the last one that set it left, turned by those after it.
    """
    ordered = Window.partitionBy("path").orderBy("start")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("plain") & ~F.col("inner"), 1).otherwise(0)
    sets = F.col("plain") == F.col("inner")
    scanned = ends.withColumn("_turned", F.sum(turns).over(ordered)).withColumn(
        "_last", F.when(sets, F.struct(F.col("plain").cast("int").alias("state"), "_turned")))
    last, turned = F.last("_last", ignorenulls=True).over(before), F.coalesce(F.sum(turns).over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + turned - F.coalesce(last["_turned"], F.lit(0))
    numbered = scanned.withColumn("quoted", F.pmod(state, F.lit(2)) == 1).withColumn(
        "range", F.row_number().over(Window.orderBy("path", "start")))
    open_behind = F.when(F.col("quoted"), F.col("inner")).otherwise(F.col("plain"))
    begins = open_behind & (~F.col("quoted") | F.col("closes"))
    return numbered.select(
        "range", "path", "start", "file", "head", "quoted",
        F.max(F.when(begins, F.col("range"))).over(before).alias("owner"), (F.col("quoted") | open_behind).alias("torn"))


def _cut_function(torn: bool):
    """Arrow batches of (range, first, quoted, value) to whole records, or to the parts of `torn` ones.

    Parts are numbered 0 where a record begins, 1 where it goes on and 2 where it ends.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(own, found):
            """`found` holds (line, part, text)."""
            return pa.RecordBatch.from_arrays(
                [pa.array([own] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())],
                ["range", "line", "part", "record"])

        def left_open():
            if waiting and torn:
                yield rows(own, [(opened, 0 if begun else 1, "\n".join(waiting))])

        own, waiting = None, []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                number, header, inside = (batch.column(n)[at].as_py() for n in ("range", "first", "quoted"))
                size = pc.sum(pc.equal(batch.column("range").slice(at), number)).as_py()  # range follows range
                if number != own:
                    yield from left_open()
                    own, line, opened, waiting, quoted, begun, skip = number, 0, 0, [], inside, not inside, header
                lines = batch.column("value").slice(at, size)
                found = []
                for text, has in zip(lines.to_pylist(), pc.match_substring(lines, '"').to_pylist()):
                    if waiting or quoted or has:
                        if not waiting:
                            opened = line
                        waiting.append(text)
                        if has:
                            quoted = ends_quoted(text, quoted)
                        if not quoted:
                            text = "\n".join(waiting).removesuffix("\r")
                            if begun and skip:
                                skip = False
                            elif begun != torn:
                                found.append((opened, 2, text))
                            waiting, begun = [], True
                    elif text and text != "\r":
                        if skip:
                            skip = False
                        elif not torn:
                            found.append((line, 2, text.removesuffix("\r")))
                    line += 1
                yield rows(own, found)
                at += size
        yield from left_open()

    return run


def range_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The ranges of all files, written out; see `_range_states`."""
    return stage(_range_states(_range_ends(_lines(spark, paths))), "csv-ranges")


def records_in(spark: SparkSession, paths: list[str], ranges: DataFrame) -> DataFrame:
    """(path, file, range, line, record): the records of files without their header lines.

    `range` and `line` tell where a record begins; a record holds its line
    breaks; empty lines are left out. Lines of a file are read by as many tasks
    as it has ranges and are not shuffled; the parts of a record that lies
    across ranges meet in a group of their own. A quote that is never closed is an error.
    """
    lines = _lines(spark, paths)
    known = ranges.select("range", "path", "start", (F.col("start") == 0).alias("first"), "quoted", "torn")

    def placed(how: str, which: DataFrame) -> DataFrame:
        found = lines.join(F.broadcast(which), ["path", "start"], how)  # one row for each range
        return found.select(
            F.coalesce("range", F.raise_error(F.lit(_UNSEEN)).cast("int")).alias("range"), "first", "quoted", "value")

    whole = placed("left", known).mapInArrow(_cut_function(False), _RECORDS).drop("part")
    parts = placed("inner", known.where("torn")).mapInArrow(_cut_function(True), _RECORDS)
    owned = parts.join(F.broadcast(ranges.select("range", "owner")), "range").withColumn(
        "owner", F.when(F.col("part") == 0, F.col("range")).otherwise(F.col("owner")))
    joined = owned.groupBy("owner").agg(
        F.array_sort(F.collect_list(F.struct("range", "line", "part", "record"))).alias("parts"))  # one record
    closed = F.element_at("parts", -1)["part"] == 2
    torn = joined.select(
        F.col("owner").alias("range"), F.get("parts", F.lit(0))["line"].alias("line"),
        F.when(closed, F.array_join(F.transform("parts", lambda p: p["record"]), "\n")).otherwise(
            F.raise_error(F.lit("a quoted field is not closed")).cast("string")).alias("record"))
    return whole.unionByName(torn).join(F.broadcast(ranges.select("range", "path", "file")), "range")


def _column_names(head: str) -> list[str]:
    return [name or f"_c{n}" for n, name in enumerate(next(csv.reader([head.removesuffix("\r")])))]


def _layout(columns: list[tuple[str, str]]) -> str:
    return ", ".join("`{}` {}".format(name.replace("`", "``"), kind) for name, kind in columns)


def _inferred_types(records: DataFrame) -> list[str]:
    spark = records.sparkSession
    strings = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark._jsparkSession.read().option("inferSchema", "true")
    for key, value in _OPTIONS.items():
        reader = reader.option(key, value)
    return [kind for _, kind in DataFrame(reader.csv(strings), spark).dtypes]


def read_csv_ranges(spark: SparkSession, paths: list[str], schema: T.StructType | None = None,
                    provenance: str | None = None, order_columns: bool = False) -> DataFrame:
    """The rows of CSV files with a header line, columns by name.

    Files with the same header are read together; others are united with
    them, and their quotes are looked at once more. With a schema, columns that it lacks are left out and those that a file
    lacks are null. Without one the types are inferred, which reads the data once more.
    """
    ranges = range_table(spark, paths)
    heads = [r[0] for r in ranges.where("head is not null").select("head").distinct().collect()]
    frames = []
    for head in sorted(heads):
        own, files = ranges, paths
        if len(heads) > 1:
            files = [unquote(r[0]) for r in ranges.where(F.col("head") == head).select("path").collect()]
            # How files are split depends on the size of all that are read together.
            own = range_table(spark, files)
        if ends_quoted(head, False):
            raise ValueError(f"line breaks in a header are not supported: {head[:80]!r}")
        frames.append(_rows(records_in(spark, files, own), _column_names(head), schema, provenance, order_columns))
    if not frames:
        empty = spark.createDataFrame([], schema or T.StructType([]))
        return empty
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def _rows(records: DataFrame, names: list[str], schema: T.StructType | None, provenance: str | None,
          order_columns: bool) -> DataFrame:
    kinds = ["string"] * len(names) if schema else _inferred_types(records)
    kinds += ["string"] * (len(names) - len(kinds))
    parsed = records.withColumn("_row", F.from_csv("record", _layout([*zip(names, kinds)]), _OPTIONS))
    cells = {name: F.col("_row").getField(name) for name in names}
    if schema:
        columns = [(cells[f.name] if f.name in cells else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    else:
        columns = [cell.alias(name) for name, cell in cells.items()]
    if provenance:
        columns.append(F.col("file").alias(provenance))
    if order_columns:
        columns += [F.col("path").alias("_path"), F.col("range").cast("bigint").alias("_split"), F.col("line").alias("_line")]
    return parsed.select(*columns)
