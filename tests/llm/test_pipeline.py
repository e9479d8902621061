import corpus_pipeline
from test_mixing import brute as brute_mix
from test_near_dup import brute_components

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(columns)] == columns
        if name != "sharding":
            assert docs.columns == columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    before, after = seen["near_duplicates"], seen["decontamination"]
    groups = {component for _, n, component in brute_components([row[:2] for row in before], 5) if n}
    assert sorted(row[0] for row in after) == sorted(groups)
    taken = {key: (t, n) for key, n, _, _, t in brute_mix(seen["mixing"])}
    copies = {}
    for row in seen["sharding"]:
        copies[row[0]] = copies.get(row[0], 0) + 1
    assert copies == {key: -(-t // n) for key, (t, n) in taken.items() if t}
    assert docs.count() == len(seen["sharding"]) and docs.select("shard").distinct().count() <= corpus_pipeline.SHARDS
    assert len(seen["near_duplicates"]) < len(seen["quality_rules"])


def test_stages_on_odd_rows_and_none(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            columns = stage(spark, docs, FOLDER).columns
            assert columns[: len(docs.columns)] == docs.columns
            assert stage(spark, docs, FOLDER).count() <= 2 * docs.count()
