import re

from conftest import prose
from pyspark.sql import functions as F

from millrace.llm.pii import DATE_PARTS, feistel, permuted_digits, pseudonymised


def luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def run(spark, *texts, key="k"):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string")
    rows = pseudonymised(docs, key, count_column="n").orderBy("doc_id").collect()
    return [(r["text"], r["n"]) for r in rows]


def test_feistel_is_a_permutation(spark):
    for a, b in ((10, 10), (3, 50), (1, 7), DATE_PARTS):
        n = min(a * b, 146_097)
        pairs = spark.range(n).select(feistel(F.floor(F.col("id") / b), F.pmod("id", F.lit(b)), (a, b), "k", "t").alias("p"))
        told = pairs.agg(F.countDistinct("p.x", "p.y"), F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
        assert tuple(told) == (n, 0, a - 1, 0, b - 1)
    digits = spark.range(1_000).select(permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert digits.distinct().count() == 1_000 and digits.where("length(d) <> 3").count() == 0


def test_formats_stay_and_equal_values_stay_linked(spark):
    (one, n), (other, m), (keyed, _) = *run(
        spark, "card 4111111111111111, +1 (555) 123-4567 on 2024-02-29 from 152.143.123.131 ssn 123-45-6789 me@x.org.",
        "4111-1111-1111-1111 or 4111 1111 1111 1111; 555-123-4567; 02/29/2024 and 29.02.2024; ME@x.org",
    ), run(spark, "card 4111111111111111", key="other")[0]
    assert (n, m) == (6, 6)
    shape = r"card (\d{16}), \+1 \((\d{3})\) (\d{3})-(\d{4}) on (\d{4})-(\d\d)-(\d\d) from (\d+\.\d+\.\d+\.\d+) ssn (\d{3})-(\d\d)-(\d{4}) (u[0-9a-f]{12}@example\.invalid)\."
    card, *phone, year, month, day, ip, _, _, _, mail = re.fullmatch(shape, one).groups()
    assert luhn(card) and card != "4111111111111111"
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    assert other == f"{spaced.replace(' ', '-')} or {spaced}; {'-'.join(phone)}; {month}/{day}/{year} and {day}.{month}.{year}; {mail}"
    assert keyed != f"card {card}" and all(int(part) <= 255 for part in ip.split("."))


def test_what_is_not_valid_stays(spark):
    text = "4111111111111112 2023-02-29 999.1.1.1 000-12-3456 666-12-3456 1.2.3 12345 99/99/2024 a@b 1234567890123456789012"
    assert run(spark, text) == [(text, 0)]


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    result = pseudonymised(odd_docs, "k")
    assert result.columns == odd_docs.columns
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(odd_rows, key=repr)
    assert pseudonymised(no_docs, "k").collect() == []
    long_ = " ".join(f"{prose(i, 50)} 4111111111111111" for i in range(300))
    (text, n), = run(spark, long_)
    assert n == 300 and "4111111111111111" not in text and len(text) == len(long_)
