import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.operators.cleaning import Step
from millrace.sources import readers, registry, versions


def test_csv(spark, tmp_path):
    path = tmp_path / "table.csv"
    path.write_text('col1,col2,note\n10,20,"a, ""b""\nc"\n30,40,\n')
    df = readers.read_table(spark, str(path))
    assert df.columns == ["col1", "col2", "note"] and df.count() == 2
    assert df.first()["col1"] == 10 and df.first()["note"] == 'a, "b"\nc'


def test_json_is_flattened(spark, tmp_path):
    path = tmp_path / "table.json"
    path.write_text(json.dumps([
        {"id": 1, "info": {"name": "Alice", "city": "NYC", "deep": {"x": [1]}}}, {"id": 2, "info": {"name": "Bob", "city": "SF"}},
    ]))
    df = readers.read_table(spark, str(path))
    assert set(df.columns) == {"id", "info.name", "info.city", "info.deep.x"} and df.count() == 2
    assert df.select("`info.name`").first()[0] == "Alice"
    assert "info" in readers.read_json(spark, str(path), flat=False).columns
    single = tmp_path / "one.json"
    single.write_text('{"id": 1}')
    assert readers.read_json(spark, str(single)).count() == 1


def test_json_of_another_root_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('"text"')
    with pytest.raises(Exception):
        readers.read_json(spark, str(path)).collect()


def test_round_trips(spark, tmp_path):
    df = spark.sql("SELECT id, concat('a\"', id, ',') AS t, id / 3 AS x, timestamp_micros(id * 1000001) AS ts FROM range(5)")
    expected = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, readers.read_parquet(spark, readers.write_parquet(df, str(tmp_path / "p"))).collect())) == expected
    back = readers.read_csv(spark, readers.write_csv(df, str(tmp_path / "c")), schema=df.schema)
    assert sorted(map(tuple, back.collect())) == expected
    with pytest.raises(Exception):
        readers.write_parquet(df, str(tmp_path / "p"))


def test_validation(spark):
    with pytest.raises(ValueError):
        readers.validated(spark.range(0))
    with pytest.raises(ValueError):
        readers.suffix_of("table.xlsx")


def test_source_of(frame):
    df = frame("u string", u=["https://raw.githubusercontent.com/a", "https://www.kaggle.com/d", "https://s.org/x.csv"])
    assert [r[0] for r in df.select(readers.source_of(F.col("u"))).collect()] == ["github", "kaggle", "cloud"]


def test_version_names():
    assert versions.version_name("sales.csv", 2) == "cleaned_sales_v2.parquet"
    assert versions.version_name("cleaned_sales_v2.parquet", 3) == "cleaned_sales_v3.parquet"


def test_versions_lineage_and_restore(spark, frame, tmp_path):
    books = registry.DatasetRegistry(spark, str(tmp_path / "registry"))
    df = frame("A bigint, B double", A=[1, 1, 2], B=[10.0, 10.0, None])
    first = versions.register(books, df, str(tmp_path / "table.parquet"), "u1", "table.csv")
    second = versions.clean_version(books, first["dataset_id"], [Step("remove_duplicates"), Step("fill_mean", "B")])
    third = versions.clean_version(books, second.record["dataset_id"], [Step("drop_column", "B")])
    assert second.record["dataset_version"] == 2 and second.record["parent_dataset_id"] == first["dataset_id"]
    assert second.report["rows_before"] == 3 and second.report["rows_after"] == 2
    assert second.report["improvements"] == ["duplicate rows removed: 1", "missing values filled: 1"]
    chain = books.lineage(third.record["dataset_id"]).collect()
    assert [r["dataset_version"] for r in chain] == [1, 2, 3] and [r["nth"] for r in chain] == [1, 2, 3]
    assert versions.restore(books, third.record["dataset_id"]).count() == 3
    assert versions.open_version(spark, third.record).columns == ["A"]
    roots = {r["dataset_id"]: (r["root"], r["generation"]) for r in registry.lineage_roots(books.records()).collect()}
    assert roots[third.record["dataset_id"]] == (first["dataset_id"], 2)


def test_registry_records(spark, tmp_path):
    books = registry.DatasetRegistry(spark, str(tmp_path / "books"))
    one = books.create({"user_id": "u", "dataset_name": "one"})
    books.create({"user_id": "u", "dataset_name": "two"})
    books.create({"user_id": "w", "dataset_name": "three"})
    books.update(one["dataset_id"], dataset_name="uno")
    assert books.get(one["dataset_id"])["dataset_name"] == "uno"
    assert books.of_user("u").count() == 2
    books.delete(one["dataset_id"])
    assert books.get(one["dataset_id"]) is None and books.of_user("u").count() == 1
    assert books.delete_all("u") == 1 and books.records().count() == 1


def test_two_writers_lose_no_change(spark, tmp_path):
    one, other = (registry.DatasetRegistry(spark, str(tmp_path / "books")) for _ in range(2))
    made = one.create({"user_id": "u", "dataset_name": "n", "row_count": 0})
    name = made["dataset_id"]
    with pytest.raises(ValueError):
        other.create({"dataset_id": name})
    commit, raced = one._commit, []

    def late(record):
        """Another writer commits between this one's reading and its commit, once."""
        if not raced:
            raced.append(other.update(name, dataset_name="theirs")["revision"])
        return commit(record)

    one._commit = late
    assert one.update(name, row_count=5)["revision"] == 2 and raced == [1]
    now = other.get(name)
    assert (now["dataset_name"], now["row_count"], now["revision"]) == ("theirs", 5, 2)
    assert one.log().count() == 3


def test_writers_at_the_same_time(spark, tmp_path):
    books = registry.DatasetRegistry(spark, str(tmp_path / "books"))
    name = books.create({"user_id": "u", "column_count": 0})["dataset_id"]
    fields = ["dataset_name", "source", "status", "source_url"]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda field: registry.DatasetRegistry(spark, books.path).update(name, **{field: "x"}), fields))
    now = books.get(name)
    assert [now[field] for field in fields] == ["x"] * 4 and now["revision"] == 4


def test_snapshots_and_tombstones(spark, tmp_path):
    books = registry.DatasetRegistry(spark, str(tmp_path / "books"))
    assert books.records().count() == 0
    names = [books.create({"user_id": "u", "dataset_name": str(i), "dataset_id": f"a/{i} b"})["dataset_id"] for i in range(3)]
    books.delete(names[0])
    assert books.fold() == 1 and books.records().count() == 2
    assert books.get(names[0]) is None and books.get(names[1])["dataset_name"] == "1"
    books.update(names[1], dataset_name="new")
    assert books.fold() == 2 and books.get(names[1])["dataset_name"] == "new" and books.records().count() == 2
    with pytest.raises(KeyError):
        books.update(names[0], dataset_name="back")
    with pytest.raises(ValueError):
        books.load(books.records())


def test_restore_without_the_original(spark, frame, tmp_path):
    books = registry.DatasetRegistry(spark, str(tmp_path / "registry"))
    first = versions.register(books, frame("A bigint", A=[1, 1, 2]), str(tmp_path / "table.parquet"), "u1", "table.csv")
    second = versions.clean_version(books, first["dataset_id"], [Step("remove_duplicates")]).record
    assert versions.restore(books, second["dataset_id"]).count() == 3
    books.delete(first["dataset_id"])
    with pytest.raises(LookupError):
        versions.restore(books, second["dataset_id"])


@pytest.mark.parametrize("length", [1, 2, 7])
def test_circles_are_errors(spark, length):
    ring = spark.range(length + 5).selectExpr("id AS dataset_id", f"CASE WHEN id < {length} THEN (id + 1) % {length} WHEN id > {length} THEN id - 1 END AS parent_dataset_id")
    with pytest.raises(ValueError):
        registry.lineage_roots(ring)
    with pytest.raises(ValueError):
        registry.lineage(ring, 0)
    assert [row["dataset_id"] for row in registry.lineage(ring, length + 2).collect()] == [length, length + 1, length + 2]


def test_plan_operations(spark):
    plans = spark.range(25).selectExpr("id % 2 AS user", "id AS plan", "timestamp_seconds(id) AS at")
    assert [tuple(r)[1] for r in registry.latest_plans(plans, ["user"], "at", "plan").orderBy("user").collect()] == [24, 23]
    assert sorted(map(tuple, registry.plan_counts(plans, ["user"]).collect())) == [(0, 10), (1, 10)]
    assert registry.plan_by_id(plans, ["user"], "at", "plan", 23).first()["nth"] == 1
    assert registry.plan_by_id(plans, ["user"], "at", "plan", 1).count() == registry.plan_by_id(plans, ["user"], "at", "plan", 99).count() == 0
    gone = registry.evicted_plans(plans, ["user"], "at", "plan")
    assert sorted(r["plan"] for r in gone.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["plan"] for r in registry.purged(plans, gone).collect()) == list(range(5, 25))
    assert {r["user"] for r in registry.purged(plans, gone.where("user = 0").select("user").distinct()).collect()} == {1}


def test_plan_history(spark):
    plans = spark.range(25).selectExpr("'u' AS user", "id AS plan", "timestamp_seconds(id) AS at")
    kept = registry.plan_history(plans, ["user"], "at", "plan").orderBy("nth").collect()
    assert [r["plan"] for r in kept] == list(range(24, 14, -1))


def test_long_lineage_takes_few_rounds(spark):
    chain = spark.range(300).selectExpr("id AS dataset_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_dataset_id")
    row = registry.lineage_roots(chain).orderBy(F.desc("generation")).first()
    assert (row["dataset_id"], row["root"], row["generation"]) == (299, 0, 299)


def test_catalogue_and_ingest(spark):
    df = spark.sql("SELECT id, id % 2 AS p, array(id) AS a FROM range(120)")
    rows = {r["name"]: (r["null_count"], r["unique_count"]) for r in registry.column_catalogue(df).collect()}
    assert rows == {"id": (0, 120), "p": (0, 2), "a": (0, -1)}
    record = registry.ingest_record(df, "t.parquet").first()
    assert (record["row_count"], record["column_count"], record["ml_readiness_score"]) == (120, 3, 100)
