import csv
import json
import random
import zipfile

import pytest

from tessera import schemas
from pyspark.sql import functions as F

from tessera.operators.position import with_file_position, with_row_id
from tessera.schemas import struct
from tessera.session import settings
from tessera.sources import readers, writers

PEOPLE = struct("a string, b int")


def rows(df):
    return sorted(((r.a, r.b) for r in df.collect()), key=str)


def test_suffix_dispatch():
    assert readers.format_of("x/y.csv.zip") == "csv.zip"
    assert readers.format_of("x/y.jsonl") == "jsonl"
    for bad in ("x.parquet", "x.zip", "x", "csv"):
        with pytest.raises(ValueError):
            readers.format_of(bad)
    assert readers.split_paths("a,b") == ["a", "b"]
    assert readers.split_paths(("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.split_paths(3)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('a,b\n"x\ny",1\n"say ""hi""",2\n plain ,3\n')
    want = sorted([("x\ny", 1), ('say "hi"', 2), (" plain ", 3)], key=str)
    assert rows(readers.read_records(spark, str(path))) == want
    assert rows(readers.read_records(spark, str(path), schema=PEOPLE)) == want


def written_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator="\n").writerows([("a", "b"), *rows])


def odd_cells(count):
    draw = random.Random(9)
    return [("".join(draw.choice('xy",\n é') for _ in range(draw.randrange(1, 90))).strip() or "-", n)
            for n in range(count)]


@pytest.mark.parametrize("size", [200, 1_000, 7_777, 1 << 20])
def test_csv_ranges_hold_all_records(spark, tmp_path, size):
    """Records across many ranges, in order, at several range sizes."""
    cells = [*odd_cells(400), ("line\n" * 300, 400), ('""\n",' * 200 + "end", 401), *odd_cells(50)]
    written_csv(tmp_path / "p.csv", cells)
    with settings(spark, spark__sql__files__maxPartitionBytes=str(size)):
        df = readers.read_records(spark, tmp_path / "p.csv", schema=PEOPLE, order_columns=True)
        assert size > 100_000 or df.select("_split").distinct().count() >= 5
        assert [(r.a, r.b) for r in df.orderBy("_path", "_split", "_line").collect()] == cells


def test_csv_files_with_other_columns_in_one_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a,b\n"x\ny",1\n5" pipe,2\r\n\n')
    (tmp_path / "two.csv").write_text('b,c,a\n3,q,z\n')
    (tmp_path / "none.csv").write_text("")
    df = readers.read_records(spark, f"{tmp_path}/one.csv,{tmp_path}/two.csv,{tmp_path}/none.csv", schema=PEOPLE,
                              provenance="src")
    assert sorted((r.a, r.b, r.src) for r in df.collect()) == [
        ('5" pipe', 2, "one.csv"), ("x\ny", 1, "one.csv"), ("z", 3, "two.csv")]
    assert readers.read_records(spark, str(tmp_path / "one.csv")).dtypes == [("a", "string"), ("b", "int")]


def test_csv_files_with_other_columns_are_split_alike_in_both_passes(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    wanted = []
    for name, columns, count in (("one", "a,b", 300), ("two", "b,a", 40)):
        lines = [(f"{name}\n\"{n}\"", n) for n in range(count)]
        with open(folder / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(columns.split(","))
            writer.writerows(r if columns == "a,b" else r[::-1] for r in lines)
        wanted += lines
    with settings(spark, spark__sql__files__openCostInBytes="1"):
        df = readers.read_records(spark, f"{folder}/one.csv,{folder}/two.csv", schema=PEOPLE)
        assert rows(df) == sorted(wanted, key=str)


def test_unclosed_quote_is_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n"x,1\ny,2\n')
    with pytest.raises(Exception, match="not closed"):
        readers.read_records(spark, tmp_path / "p.csv", schema=PEOPLE).collect()


def test_json_documents(spark, tmp_path):
    listed, columnar = tmp_path / "l.json", tmp_path / "c.json"
    listed.write_text(json.dumps([{"a": "x", "b": 1}, {"a": "y"}], indent=1))
    columnar.write_text(json.dumps({"a": {"0": "p", "1": "q"}, "b": {"0": 3, "1": None}}))
    want = sorted([("x", 1), ("y", None), ("p", 3), ("q", None)], key=str)
    both = readers.read_records(spark, f"{listed},{columnar}", schema=PEOPLE)
    assert rows(both) == want
    inferred = readers.read_records(spark, str(columnar))
    assert sorted((r.a, r.b) for r in inferred.fillna("-").collect()) == [("p", "3"), ("q", "-")]
    ordered = readers.read_records(spark, str(columnar), schema=PEOPLE, order_columns=True)
    assert [r.a for r in ordered.orderBy("_path", "_split", "_line").collect()] == ["p", "q"]


def test_json_lines_blank_lines_and_missing_columns(spark, tmp_path):
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text('{"a":"x","b":1}\n\n{"a":"y","b":2}\n')
    two.write_text('{"a":"z"}\n')
    df = readers.read_records(spark, [one, two], schema=PEOPLE, provenance="data_source")
    assert sorted((r.a, r.b, r.data_source) for r in df.fillna(-1).collect()) == [
        ("x", 1, "one.jsonl"), ("y", 2, "one.jsonl"), ("z", -1, "two.jsonl")]


def test_mixed_formats_unite_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nx,1\n")
    (tmp_path / "y.jsonl").write_text('{"a":"y","c":2}\n')
    df = readers.read_records(spark, f"{tmp_path}/x.csv,{tmp_path}/y.jsonl")
    assert sorted(df.columns) == ["a", "b", "c"]
    assert df.count() == 2


@pytest.mark.parametrize("fmt,content", [
    ("csv.zip", 'a,b\n"x\ny",1\nz,2\n'),
    ("jsonl.zip", '{"a":"x\\ny","b":1}\n\n{"a":"z","b":2}\n'),
    ("json.zip", '[{"a":"x\\ny","b":1},{"a":"z","b":2}]'),
    ("json.zip", '{"a":{"0":"x\\ny","1":"z"},"b":{"0":1,"1":2}}'),
])
def test_zipped(spark, tmp_path, fmt, content):
    path = tmp_path / f"p.{fmt}"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("p." + fmt.removesuffix(".zip"), content)
    for schema in (PEOPLE, None):
        df = readers.read_records(spark, path, schema=schema, provenance="src", order_columns=True)
        got = df.orderBy("_path", "_split", "_line").collect()
        assert [(r.a, int(r.b), r.src) for r in got] == [("x\ny", 1, path.name), ("z", 2, path.name)]


def test_zip_without_inner_suffix_needs_a_format(spark, tmp_path):
    path = tmp_path / "test.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("t.jsonl", '{"a":"x","b":1}\n')
    with pytest.raises(ValueError):
        readers.read_records(spark, path)
    assert rows(readers.read_records(spark, path, fmt="jsonl.zip", schema=PEOPLE)) == [("x", 1)]


def test_text_keeps_empty_lines_in_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3\n\n4\n")
    (tmp_path / "a.txt").write_text("1\n2\n")
    lines = readers.read_text_lines(spark, f"{tmp_path}/b.txt,{tmp_path}/a.txt", order_columns=True)
    numbered = with_row_id(lines, ["_path", "_split", "_line"])
    assert [(r.row_id, r.text) for r in numbered.orderBy("row_id").collect()] == list(
        enumerate(["3", "", "4", "1", "2"]))


def test_many_splits_keep_the_order(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{n}\n" for n in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        lines = readers.read_text_lines(spark, str(tmp_path / "big.txt"), order_columns=True)
        assert lines.select("_split").distinct().count() > 5
        numbered = with_row_id(lines, ["_path", "_split", "_line"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(int(r.text) == r.row_id for r in numbered) and len(numbered) == 5000


def test_directory_takes_only_matching_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":"x","b":1}\n')
    (tmp_path / "y.txt").write_text('{"a":"y","b":1}\n')
    assert rows(readers.read_directory(spark, tmp_path, schema=PEOPLE)) == [("x", 1)]


def test_jsonl_sink_writes_nulls_and_unicode(spark, tmp_path):
    path = str(tmp_path / "o.jsonl")
    df = spark.createDataFrame([("é\n", None), ("z", 2)], "a string, b int")
    writers.write_jsonl(df, path)
    text = "\n".join(p.read_text() for p in (tmp_path / "o.jsonl").glob("part*"))
    assert '"b":null' in text and "é" in text
    assert rows(readers.read_records(spark, path, schema=PEOPLE)) == rows(df)


def test_append_and_start_over(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int")
    target = writers.append_results(df, str(tmp_path / "out"), rows_per_file=1)
    assert target.endswith("/generate.jsonl")
    writers.append_results(df, str(tmp_path / "out"))
    assert readers.read_records(spark, target, schema=PEOPLE).count() == 4
    writers.append_results(df, str(tmp_path / "out"), resume=False)
    assert readers.read_records(spark, target, schema=PEOPLE).count() == 2
    path = writers.append_results(df, str(tmp_path / "out.csv"))
    assert rows(readers.read_records(spark, path, schema=PEOPLE)) == rows(df)
    with pytest.raises(ValueError):
        writers.append_results(df, "x.xlsx")


def test_cache_prepares_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def prepare():
        calls.append(1)
        return spark.range(3)

    assert writers.cached(spark, path, prepare).count() == 3
    assert writers.cached(spark, path, prepare).count() == 3
    assert len(calls) == 1


def test_schemas_need_no_session():
    assert schemas.SCORE.simpleString() == "struct<qid:bigint,i:bigint,score:double>"


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nx,1\n")
    (tmp_path / "b.csv").write_text("b,a\n2,y\n")
    both = f"{tmp_path}/a.csv,{tmp_path}/b.csv"
    for schema in (None, PEOPLE):
        assert rows(readers.read_records(spark, both, schema=schema)) == [("x", 1), ("y", 2)]
        ordered = readers.read_records(spark, f"{tmp_path}/b.csv,{tmp_path}/a.csv", schema=schema, order_columns=True)
        assert [r.a for r in ordered.orderBy("_path", "_split", "_line").collect()] == ["y", "x"]


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a":"x","b":1},{"a":"y"')
    (tmp_path / "object.json").write_text('{"a":{"0":"x"},"b":{"0"')
    (tmp_path / "bad.jsonl").write_text('{"a":"x","b":1}\nnot json\n')
    for name in ("cut.json", "object.json", "bad.jsonl"):
        with pytest.raises(Exception, match="(?i)malformed"):
            readers.read_records(spark, tmp_path / name, schema=PEOPLE).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_directory(spark, tmp_path, "*.none")


def test_directory_finds_written_folders(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int")
    writers.append_results(df, writers.shard_path(str(tmp_path), 0, 2))
    writers.append_results(df, writers.shard_path(str(tmp_path), 1, 2))
    assert readers.read_directory(spark, tmp_path, schema=PEOPLE).count() == 4


def test_unfinished_cache_is_prepared_again(spark, tmp_path):
    """What a writer left aside is no table, and nothing reads it."""
    path = tmp_path / "cache"
    spark.range(7).write.parquet(str(path / "_writing-left"))
    assert writers.cached(spark, str(path), lambda: spark.range(100).repartition(4)).count() == 100
    assert [f.name for f in path.iterdir() if not f.name.startswith("_")] == [writers.cache_key(spark)]


def test_cache_follows_its_inputs_and_settings(spark, tmp_path):
    source, path = tmp_path / "in.jsonl", str(tmp_path / "cache")

    def made(**settings):
        return writers.cached(spark, path, lambda: spark.read.text(str(source)), [str(source)], **settings).count()

    source.write_text("x\n")
    assert made(size=1) == 1
    source.write_text("x\ny\n")
    assert made(size=1) == 2  # the input has changed
    source.write_text("x\ny\nz\n")
    assert made(size=2) == 3 and made(size=2) == 3


def test_two_writers_leave_one_whole_table(spark, tmp_path):
    path = str(tmp_path / "cache")

    def slow():
        # Another writer is done first.
        assert writers.cached(spark, path, lambda: spark.range(5)).count() == 5
        return spark.range(5)

    assert writers.cached(spark, path, slow).count() == 5
    assert [f.name for f in (tmp_path / "cache").iterdir()] == [writers.cache_key(spark)]
    table = tmp_path / "cache" / writers.cache_key(spark)
    assert not [f for f in table.iterdir() if f.is_dir()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3_000, 50_000, 1 << 27])
def test_positions_without_moving_rows(spark, tmp_path, size):
    """The same numbers at any size of splits, and no shuffle."""
    spark.range(5_000).repartitionByRange(3, "id").sortWithinPartitions("id").select(
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).write.text(str(tmp_path / "t.txt"))
    with settings(spark, spark__sql__files__maxPartitionBytes=str(size)):
        numbered = with_file_position(readers.read_text_lines(spark, tmp_path / "t.txt", order_columns=True))
        assert "Exchange hashpartitioning" not in plan_of(numbered) and "rangepartitioning" not in plan_of(numbered)
        assert sorted((r.row_id, r.text) for r in numbered.collect()) == [(n, f"line {n}") for n in range(5_000)]


def test_positions_of_rows_that_are_not_counted_one_by_one(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n"x\ny",1\nz,2\n')
    read = readers.read_records(spark, tmp_path / "p.csv", schema=PEOPLE, order_columns=True)
    assert sorted((r.row_id, r.b) for r in with_file_position(read).collect()) == [(0, 1), (1, 2)]


def test_code_references_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("diag,diag_code\nred,A\nblue,B\n")
    (tmp_path / "a.csv").write_text("diag_code,diag\nC,green\n")
    found = readers.read_code_references(spark, f"{tmp_path}/b.csv,{tmp_path}/a.csv").collect()
    assert sorted((r.ref_id, r.diag, r.diag_code) for r in found) == [(0, "red", "A"), (1, "blue", "B"), (2, "green", "C")]


def test_unzipped_records_come_in_bounded_chunks(monkeypatch):
    monkeypatch.setattr(readers, "_CHARACTERS_PER_BATCH", 100)
    records = ["x" * 30] * 10 + ["y" * 500] + ["z"] * 5
    chunks = list(readers._chunks(iter(records)))
    assert [r for c in chunks for r in c] == records
    assert all(sum(map(len, c[:-1])) < 100 for c in chunks)


def test_written_files_grow_in_number_with_the_input(spark, tmp_path, monkeypatch):
    from tessera.registry import file_queries, token_queries, views
    rows = spark.createDataFrame(
        [(n, f'line "{n}",\n\nsecond {n} ' + "w " * 50, "en" if n % 3 else "de") for n in range(200)],
        "doc_id long, text string, lang string").repartition(6)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    plain = {q.__name__: sorted(map(tuple, q(spark, str(tmp_path)).collect()))
             for q in (file_queries.src_csv_ranges, file_queries.src_text, token_queries.pretrain_from_files)}
    monkeypatch.setattr(views, "FILE_BYTES", 5000)
    assert views.file_count(25_000) == 6
    for q in (file_queries.src_csv_ranges, file_queries.src_text, token_queries.pretrain_from_files):
        assert sorted(map(tuple, q(spark, str(tmp_path)).collect())) == plain[q.__name__]
