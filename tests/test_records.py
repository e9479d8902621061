import csv
import io
import json
import random
import re

import pytest

from millrace.plans import queries
from millrace.sources.readers import read_csv, read_json
from millrace.sources.records import csv_pieces, csv_records, json_pieces, json_records

FIELDS = ["a", "x,y", "line\nbreak", "two\n\nbreaks", 'say "hi"', '"', '""', "é\r\nb", "", "  pad ", ",\n,", '"\n"']


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of so few bytes that records, quotes and escapes lie on their borders."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def written(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(["id", "b", "c", "d"])
        writer.writerows(rows)
    return str(path)


def texts(df):
    """Rows as texts; the multi-line reader rewrites line breaks inside fields where lines end in a return, this one keeps them."""
    return sorted(str(row).replace("\\r\\n", "\\n") for row in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_many_ranges_equals_the_multi_line_reader(small_ranges, tmp_path, end):
    generator = random.Random(1)
    rows = [[str(i)] + [generator.choice(FIELDS) for _ in range(3)] for i in range(60)]
    path = written(tmp_path / "t.csv", rows, end)
    records = csv_records(csv_pieces(small_ranges, path)).collect()
    assert len({row["range"] for row in records}) > 3
    assert sorted(next(csv.reader(io.StringIO(row["record"], newline=""))) for row in records) == sorted([["id", "b", "c", "d"], *rows])
    plain = small_ranges.read.option("header", True).option("escape", '"').option("multiLine", True)
    mine = read_csv(small_ranges, path)
    one_task = plain.option("inferSchema", True).csv(path)
    assert mine.schema == one_task.schema
    assert texts(mine) == texts(one_task)
    schema = "id long, b string, c string, d string"
    assert texts(read_csv(small_ranges, path, schema)) == texts(plain.schema(schema).csv(path))


def test_every_border_of_a_small_file(spark, tmp_path):
    rows = [["1", 'a"\n"b', "x"], ["2", "\n", '""'], ["3", "", '"']]
    path = written(tmp_path / "t.csv", rows)
    key = "spark.sql.files.maxPartitionBytes"
    before, before_cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (1, 3, 8):
            spark.conf.set(key, str(size))
            records = csv_records(csv_pieces(spark, path)).collect()
            assert sorted(next(csv.reader(io.StringIO(row["record"], newline=""))) for row in records) == sorted([["id", "b", "c", "d"], *rows])
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", before_cost)


def test_quotes_inside_plain_fields_separators_and_headers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\n\nsize,size,,note\n5" pipe,1,2,"a\x1eb\n"\n\n6" pipe,3,4,plain\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["size0", "size1", "_c2", "note"]
    assert sorted(map(tuple, df.collect())) == [('5" pipe', 1, 2, "a\x1eb\n"), ('6" pipe', 3, 4, "plain")]
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv")).columns == []
    (tmp_path / "header.csv").write_text("a,b\n")
    only = read_csv(spark, str(tmp_path / "header.csv"))
    assert only.columns == ["a", "b"] and only.count() == 0


def test_files_of_a_folder_each_lose_their_header(small_ranges, tmp_path):
    for i in range(3):
        written(tmp_path / f"{i}.csv", [[str(10 * i + j), "l\nm", "", ""] for j in range(20)])
    df = read_csv(small_ranges, str(tmp_path))
    assert sorted(row["id"] for row in df.collect()) == sorted(10 * i + j for i in range(3) for j in range(20))


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}])
def test_json_arrays_in_many_ranges(small_ranges, tmp_path, layout):
    generator = random.Random(2)
    marks = ["}", "{", "[", "]", '"', "\\", "a\nb", '\\"}', "é", "\\\\", "},{", '"}']
    objects = [{"i": i, "s": "".join(generator.choice(marks) for _ in range(3)), "n": {"k": [{"z": "}{"}, {"z": "]"}], "t": generator.choice(marks)}} for i in range(60)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(objects, **layout) + "\n")
    records = json_records(json_pieces(small_ranges, str(path))).collect()
    assert len({row["range"] for row in records}) > 3
    assert sorted((json.loads(row["record"]) for row in records), key=lambda found: found["i"]) == objects
    mine, one_task = read_json(small_ranges, str(path), flat=False), small_ranges.read.option("multiLine", True).json(str(path))
    assert mine.schema == one_task.schema and sorted(map(str, mine.collect())) == sorted(map(str, one_task.collect()))


def test_json_documents_of_one_object_and_of_none(spark, tmp_path):
    for name, text in {"a": '{"id": 1, "x": {"y": "}"}}', "b": '﻿\n [ {"id": 2, "x": {"y": "["}} , {"id": 3}\n]\n', "c": "[]", "d": '[{"id": 4}]'}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    assert sorted((row["id"], row["x.y"]) for row in read_json(spark, str(tmp_path)).collect()) == [(1, "}"), (2, "["), (3, None), (4, None)]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_no_task_sorts_the_pieces_of_a_range(spark, tmp_path, capsys, kind):
    path = tmp_path / f"t.{kind}"
    if kind == "csv":
        written(path, [[str(i), "a\nb", "", ""] for i in range(20)])
        records = csv_records(csv_pieces(spark, str(path)))
    else:
        path.write_text(json.dumps([{"i": i, "s": "}"} for i in range(21)]))
        records = json_records(json_pieces(spark, str(path)))
    assert records.where("record <> ''").count() == 21
    capsys.readouterr()
    records.explain()
    plan = capsys.readouterr().out
    assert not re.search(r"windowspecdefinition\(file#\d+, range#\d+L, nth", plan)
    assert not re.search(r"hashpartitioning\(file#\d+, range#\d+L, number", plan)


def test_pieces_that_are_read_back_in_any_order(small_ranges, tmp_path):
    rows = [[str(i), "a\nb", '"', "\n\n" * (i % 3)] for i in range(60)]
    pieces = csv_pieces(small_ranges, written(tmp_path / "t.csv", rows))
    for read in (pieces, pieces.repartition(5), pieces.repartition(1).sortWithinPartitions("nth", ascending=False)):
        records = csv_records(read).collect()
        assert sorted(next(csv.reader(io.StringIO(row["record"], newline=""))) for row in records) == sorted([["id", "b", "c", "d"], *rows])
        assert [row["record"] for row in records if row["first"]] == ["id,b,c,d"]


def test_documents_of_arrays_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "ARRAY_ROWS", 30)
    events = spark.range(200).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "concat('{\"k\": ', id, '}') AS props",
    )
    documents = spark.read.text(queries.json_arrays(events), wholetext=True)
    sizes = [len(json.loads(row["value"])) for row in documents.collect()]
    assert sum(sizes) == 200 and max(sizes) <= 30
    assert sorted(map(str, queries.json_array(events).collect())) == sorted(map(str, queries.json_flat(events).collect()))
