import gzip
import hashlib

from millrace.llm.storage import store_of
from millrace.llm.warc import members, parse, resolve, write_archives

LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (4, "http://a b\r\nX: y", "short"), (6, "http://a/6", "short"),
    (7, "http://a/7", None), (8, "http://a/8", ""), (10, "http://a/é", "<p>é漢</p>" * 40), (None, "http://n", LONG),
    (11, "u", "\r\n\r\n" * 60), (12, "u", "\r\n\r\n" * 60), (3, "http://a/3", LONG), (None, None, "z" * 150), (None, None, "z" * 150),
    (13, "u", "y" * 3_000_000),
]


def brute(rows):
    payloads = [(key, (html or "").encode()) for key, _, html in rows]
    told = []
    for key, payload in payloads:
        first = min((k for k, other in payloads if other == payload and k is not None), default=None) if len(payload) >= 100 else None
        revisit = first is not None and key != first
        told.append((key, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(told, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*row, "a", "b", "c") for row in rows], "page_id long, url string, html string, digest string, first string, record_type string")


def test_round_trip(spark):
    files = write_archives(pages(spark, ROWS).repartition(3))
    assert sorted(map(tuple, resolve(files).collect()), key=repr) == brute(ROWS)
    for row in files.collect():
        store, inside = store_of(row["path"])
        with store.open_input_stream(inside, compression=None) as file:
            raw = file.read()
        with store.open_input_stream(inside, compression=None) as file:
            assert b"".join(members(file)) == gzip.decompress(raw)
        with store.open_input_stream(inside, compression=None) as file:
            found = [parse(member) for member in members(file)]
        assert len(found) == row["n_records"] + 1 and found[0][0]["warc-type"] == "warcinfo"
        assert all("x" not in fields for fields, _ in found)
        assert all(b"xxx" not in block for fields, block in found if fields["warc-type"] == "revisit")


def test_many_copies_of_one_page(spark):
    rows = [(100 - i, f"http://a/{i}", LONG) for i in range(90)] + [(200 + i, "u", f"{i} " * 60) for i in range(20)]
    assert sorted(map(tuple, resolve(write_archives(pages(spark, rows).repartition(4))).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert resolve(write_archives(pages(spark, ROWS).limit(0))).collect() == []


def test_revisit_of_a_lost_response(spark):
    files = write_archives(pages(spark, ROWS[:3]).repartition(3, "page_id"))
    found = {}
    for path in [row["path"] for row in files.collect()]:
        for r in resolve(files.where(files.path == path)).collect():
            found[r["page_id"]] = (r["record_type"], r["refers_to"])
    assert found[3] == ("response", None)
    assert {kind for key, (kind, _) in found.items() if key != 3} == {"revisit"}
