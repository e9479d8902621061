import numpy as np
from conftest import edited, prose

from millrace.llm.decontaminate import align, contaminated, drop_contaminated, plain_words


def plain_score(passage, item):
    table = [[0] * (len(item) + 1) for _ in range(len(passage) + 1)]
    best = 0
    for i, word in enumerate(passage, 1):
        for j, other in enumerate(item, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if word == other else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_table():
    generator = np.random.default_rng(2)
    for _ in range(60):
        passage, item = generator.integers(0, 5, generator.integers(1, 40)), generator.integers(0, 5, generator.integers(1, 15))
        assert align(passage, item)[0] == plain_score(passage.tolist(), item.tolist())


def test_copies_are_found_and_clean_texts_are_not(spark):
    items = [(i, prose(50 + i, 40, 2_000)) for i in range(6)] + [(6, "too short"), (7, None), (8, ""), (None, prose(60, 30, 2_000))]
    shouted = items[1][1].upper().replace(" ", ", ")
    deleted = " ".join(word for i, word in enumerate(items[2][1].split(" ")) if i % 6)
    rows = [
        (0, prose(1, 300, 2_000) + " " + items[0][1] + " " + prose(2, 300, 2_000)),
        (1, shouted), (2, prose(3, 20, 2_000) + " " + deleted), (3, "start " + edited(items[3][1], 9, 6)),
        (4, prose(4, 20_000, 2_000) + " " + items[4][1]), (5, prose(5, 500, 2_000)), (6, None), (7, ""), (8, "too short"),
        (None, items[0][1]), (10, " ".join(items[5][1].split(" ")[:10])), (0, prose(6, 50, 2_000) + " " + items[5][1]),
    ]
    docs = spark.createDataFrame([(key, text, "x", "y") for key, text in rows], "doc_id long, text string, item_id string, score string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(docs, benchmark).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=repr) == sorted([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (None, 0), (0, 5)], key=repr)
    for r in found:
        if r["doc_id"] == 4:
            assert (r["first_word"], r["last_word"], r["score"]) == (20_000, 20_040, 1.0)
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 8, 10]


def test_copies_of_accented_items_in_other_casing_and_quotes(spark):
    french = "l'été dernier élodie préféra déjà goûter à Évian où naît l'âme légère, près d'un théâtre fermé à Noël"
    german = "die Straße nach Süden führt über große Brücken, während müde Gäste früh schlafen und Käse für Jürgen heiß bleibt"
    spanish = "¿cuándo volverá el niño a la montaña? mañana según él, después del café, aún quizá más allá del río pequeño"
    items = [(i, text) for i, text in enumerate((french, german, spanish))]
    quoted = "\u201c" + french.replace("'", "\u2019").replace(" ", "\u00a0") + "\u201d\u2026"
    rows = [(i, prose(700 + i, 30) + " " + text.upper() + " " + prose(710 + i, 30)) for i, text in items]
    rows += [(3, french.title()), (4, quoted), (5, prose(720, 60) + " préféra déjà Évian")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(docs, benchmark).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (3, 0): 1.0, (4, 0): 1.0}
    assert [r["doc_id"] for r in drop_contaminated(docs, benchmark).collect()] == [5]


def test_brute_force_on_small_texts(spark):
    """Every pair whose plain score is half of the item's own or more, and that shares four words, is found."""
    items = [(i, prose(200 + i, 12, 30)) for i in range(4)]
    rows = [(i, prose(300 + i, 20, 30) + " " + edited(items[i % 4][1], i, i % 7) + " " + prose(400 + i, 15, 30)) for i in range(28)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(docs, benchmark, least=0.5).collect()}
    for key, text in rows:
        for item, other in items:
            passage, sought = plain_words(text.encode()), plain_words(other.encode())
            runs = {tuple(sought[i : i + 4]) for i in range(len(sought) - 3)}
            share = plain_score(passage, sought) / (2 * len(sought))
            if share >= 0.5 and runs & {tuple(passage[i : i + 4]) for i in range(len(passage) - 3)}:
                assert found[key, item] >= 0.5
            elif share < 0.5:
                assert (key, item) not in found


def test_empty_tables(spark, odd_docs, odd_rows, no_docs):
    benchmark = spark.createDataFrame([(1, prose(1, 40, 2_000))], "item_id long, text string")
    assert contaminated(no_docs, benchmark).collect() == []
    assert contaminated(odd_docs, benchmark.limit(0)).collect() == []
    assert drop_contaminated(odd_docs, benchmark).count() == len(odd_rows)
    assert drop_contaminated(odd_docs, benchmark.limit(0)).count() == len(odd_rows)
