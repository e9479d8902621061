import zlib

from conftest import prose

from millrace.llm.sharding import copy_links, propagate, sharded, sharded_documents


def test_odd_rows(odd_docs, odd_rows):
    rows = sharded(odd_docs, shards=3).collect()
    told = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows), key=repr)
    texts = [(row[0], (row[1] or "").encode()) for row in odd_rows]
    assert told == sorted(((key, len(text) + 8, zlib.crc32(text), "bytes", None) for key, text in texts), key=repr)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 3
    again = sorted((tuple(r) for r in sharded(odd_docs, shards=3).collect()), key=repr)
    assert again == sorted((tuple(r) for r in rows), key=repr)


def check_even(rows, shards, largest):
    totals = [sum(r["size"] for r in rows if r["shard"] == shard) for shard in range(shards)]
    assert max(abs(total - sum(totals) / shards) for total in totals) <= largest


def divided(rows):
    places, sizes = {}, {}
    for r in rows:
        places.setdefault(r["text_crc32"], set()).add(r["shard"])
        sizes[r["text_crc32"]] = sizes.get(r["text_crc32"], 0) + r["size"]
    return {key: sizes[key] for key, found in places.items() if len(found) > 1}


def check_slots(rows, shards):
    for shard in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_sizes_are_even_and_copies_stay_together(spark):
    texts = [prose(i, 30 + i % 50) for i in range(300)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(1_000 + i, texts[i % 60]) for i in range(180)]
    rows = sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    check_even(rows, 6, max(r["size"] for r in rows))
    check_slots(rows, 6)
    assert divided(rows) == {}


def test_a_third_of_all_rows_are_one_text(spark):
    rows = [(i, prose(i, 40)) for i in range(200)] + [(1_000 + i, "the same text again") for i in range(400)]
    rows = sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check_even(rows, 4, max(r["size"] for r in rows))
    check_slots(rows, 4)


def test_no_group_that_fits_is_divided(spark):
    """Groups of two to forty copies beside one text that holds a third of all rows and is larger than a shard."""
    texts = [prose(i, 30) for i in range(300)]
    rows = [(100 * i + copy, text) for i, text in enumerate(texts) for copy in range(40 if i % 60 == 0 else 2 + i % 5)]
    rows += [(100_000 + i, prose(999, 30)) for i in range(750)]
    rows = sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=12).collect()
    check_even(rows, 12, max(r["size"] for r in rows))
    check_slots(rows, 12)
    mean = sum(r["size"] for r in rows) / 12
    assert len(divided(rows)) == 1 and min(divided(rows).values()) > mean


def test_rounds_move_scattered_copies_together(spark):
    """On the query's own path: copies begin scattered, and the first rounds gather them."""
    texts = [prose(i, 30) for i in range(400)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(1_000 + i, texts[i % 80]) for i in range(240)]
    docs, history = spark.createDataFrame(rows, "doc_id long, text string"), []
    sharded(docs, shards=8, history=history).collect()
    assert history[0]["moved"] > 100 and history[0]["cut"] > 2 * 240 * 0.7  # seven of eight random neighbours are elsewhere
    assert history[-1]["cut"] < 0.2 * history[0]["cut"] and len(history) > 1


def test_propagation_gathers_clusters_of_any_links(spark):
    nodes = spark.createDataFrame([(f"{c}-{i}", 10) for c in range(8) for i in range(20)], "node string, size long")
    links = [(f"{c}-{i}", f"{c}-{(i + step) % 20}", 1) for c in range(8) for i in range(20) for step in (1, 2, 3)]
    labels = {r["node"]: r["shard"] for r in propagate(nodes, spark.createDataFrame(links, "a string, b string, weight int"), 4, rounds=8).collect()}
    cut = sum(labels[a] != labels[b] for a, b, _ in links)
    assert len(labels) == 160 and cut < 0.5 * len(links)  # a random placement cuts three quarters
    full = max(sum(10 for label in labels.values() if label == shard) for shard in range(4))
    assert full <= 1.3 * 400 + 10 * 20


def test_estimated_sizes_do_not_multiply_over_rounds(spark, capsys):
    """A product for each join of each round would make numbers of so many digits that the driver has no room for them."""
    nodes = spark.range(200).selectExpr("CAST(id AS STRING) AS node", "10L AS size")
    links = spark.range(199).selectExpr("CAST(id AS STRING) AS a", "CAST(id + 1 AS STRING) AS b", "1 AS weight")
    history = []
    labels = propagate(nodes, links, 4, rounds=3, history=history)
    assert len(history) == 3
    labels.explain("cost")
    assert "E+" not in capsys.readouterr().out.split("== Physical Plan ==")[0]


def test_links_are_trees_without_large_hubs(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.sharding.HUB_BUCKETS", 8)
    nodes = spark.createDataFrame([(f"{i:03d}", "d" if i < 50 else str(i)) for i in range(60)], "node string, digest string")
    links = [(r["a"], r["b"]) for r in copy_links(nodes).collect()]
    assert len(links) == 49
    reached = {"000"}
    for _ in range(3):
        reached |= {a for a, b in links if b in reached} | {b for a, b in links if a in reached}
    assert len(reached) == 50
    assert max(sum(node in link for link in links) for node in reached) < 25


def test_columns_stay_and_empty_table(odd_docs, odd_rows, no_docs):
    placed = sharded_documents(odd_docs, shards=2)
    assert placed.columns == [*odd_docs.columns, "shard_", "slot"]
    assert sorted((tuple(r)[: len(odd_docs.columns)] for r in placed.collect()), key=repr) == sorted(odd_rows, key=repr)
    assert sharded(no_docs).collect() == []
    assert sharded_documents(no_docs).collect() == []
