import re

import numpy as np
import pytest
from conftest import prose

from millrace.llm.quality_vote import RULES, estimate, faults, faulty, judged, keep_good, quality
from millrace.session import cut_lineage
from pyspark.sql import functions as F

BREAKS = "[\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = [word for word in re.split(BREAKS, text) if word]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for window in windows:
        count[window] = count.get(window, 0) + 1
    covered = {place for i, window in enumerate(windows) if count[window] > 1 for place in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    symbols = sum(text.count(sign) for sign in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_figures_of_odd_rows(odd_docs, odd_rows):
    result = quality(odd_docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *[r[name] for name in names]) for r in result), key=repr) == sorted(((row[0], *brute(row[1])) for row in odd_rows), key=repr)
    assert not any(r["kept"] for r in result if r["base_failed"])


def lettered(seed, n_words):
    return prose(seed, n_words, 5_000).translate(str.maketrans("0123456789", "aeioulrstn"))


def junk(kind, seed):
    words = lettered(seed, 120).split(" ")
    return " ".join(word + "###" if kind == 0 else word.upper() + "!!" for word in words)


def test_junk_goes_and_clean_documents_stay(spark):
    rows = [(i, lettered(i, 100 + i) + ".") for i in range(150)] + [(1_000 + i, junk(i % 2, i)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality(docs).collect()}
    assert all(kept[key] == (key < 1_000) for key in kept)
    assert sorted(r["doc_id"] for r in keep_good(docs).collect()) == list(range(150))


def drawn(seed, n, share, false, hit, abstain=0.0):
    """Counts of vote patterns of ``n`` documents whose rules err as told, independently of each other."""
    generator = np.random.default_rng(seed)
    fault = generator.random(n) < share
    bad = generator.random((n, len(false))) < np.where(fault[:, None], hit, false)
    votes = np.where(generator.random(bad.shape) < abstain, "-", np.where(bad, "0", "1"))
    patterns, counts = np.unique(["".join(row) for row in votes], return_counts=True)
    return dict(zip(patterns.tolist(), counts.tolist()))


def plain_posterior(counts, rounds=500):
    """Expectation-maximisation with a row for each document: pattern -> probability of the fault."""
    rows = np.array([list(pattern) for pattern, n in counts.items() for _ in range(n)])
    bad, voted = rows == "0", rows != "-"
    n_bad, n_good = bad.sum(axis=1), (rows == "1").sum(axis=1)
    chance = np.select([n_bad > n_good, (n_bad == n_good) & (n_bad > 0)], [0.9, 0.5], 0.01)
    for _ in range(rounds):
        share = (chance.sum() + 0.5) / (len(rows) + 1)
        rate = [((bad * weight[:, None]).sum(axis=0) + 0.5) / ((voted * weight[:, None]).sum(axis=0) + 1) for weight in (1 - chance, chance)]
        false, hit = np.minimum(rate[0], 0.4), np.maximum(rate[1], 0.6)
        of = [np.where(bad, p, 1 - p) ** voted for p in (false, hit)]
        ahead = [(1 - share) * of[0].prod(axis=1), share * of[1].prod(axis=1)]
        chance = ahead[1] / (ahead[0] + ahead[1])
    return {"".join(row): value for row, value in zip(rows, chance)}


def test_estimate_equals_plain_expectation_maximisation():
    counts = drawn(1, 3_000, 0.1, [0.02, 0.1, 0.05], [0.9, 0.8, 0.95], abstain=0.2)
    fault = estimate(counts, 3)
    for pattern, wanted in plain_posterior(counts).items():
        assert faulty(pattern, fault) == pytest.approx(wanted, abs=1e-3)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("share", [0.02, 0.1, 0.3])
def test_accuracies_are_recovered(seed, share):
    false, hit = [0.02, 0.3, 0.05], [0.9, 0.95, 0.8]
    fault = estimate(drawn(seed, 100_000, share, false, hit, abstain=0.1), 3)
    assert fault.share == pytest.approx(share, abs=0.015)
    assert fault.false == pytest.approx(false, abs=0.015) and fault.hit == pytest.approx(hit, abs=0.12 if share < 0.1 else 0.04)


@pytest.mark.parametrize("noise", [0.01, 0.05, 0.2, 0.35])
@pytest.mark.parametrize("share", [0.0, 0.001, 0.05])
def test_a_noisy_rule_is_outvoted(noise, share):
    fault = estimate(drawn(5, 50_000, share, [noise, 0.005, 0.005], [0.9, 0.9, 0.9]), 3)
    assert fault.false[0] == pytest.approx(noise, abs=0.02)
    assert faulty("011", fault) < 0.1
    if share:
        assert faulty("000", fault) > 0.9


@pytest.mark.parametrize("total", [100_000, 30_000_000])
@pytest.mark.parametrize("rare", [1e-5, 1e-4, 1e-3, 1e-2])
def test_a_rare_fault_is_found_as_several_rules_see_it(total, rare):
    left = 1 - rare
    counts = {"111": left * 0.97, "011": left * 0.01, "101": left * 0.01, "11-": left * 0.01, "000": rare * 0.8, "001": rare * 0.1, "100": rare * 0.1}
    fault = estimate({pattern: round(total * share) for pattern, share in counts.items()}, 3)
    assert faulty("000", fault) > 0.9 and faulty("011", fault) < 0.1 and faulty("101", fault) < 0.1 and faulty("11-", fault) < 0.01


def test_no_votes_and_one_row():
    assert faulty("---", estimate({"---": 5}, 3)) < 0.5
    assert faulty("111", estimate({"111": 1}, 3)) < 0.5
    assert estimate({}, 3).share == 0.5


def test_a_document_with_one_bad_vote_of_three_stays(spark):
    """Every fourth document repeats a phrase, so that one rule on repetition calls it bad; the other two know better."""
    def phrase(i):
        return " one phrase that comes back often here" * 2 if i % 4 == 0 else ""

    rows = [(i, f"{lettered(i, 70)}.{phrase(i)}") for i in range(120)] + [(1_000 + i, junk(i % 2, i)) for i in range(8)]
    found = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("0" in found[i]["votes"] for i in range(120)) == 30
    assert all(found[key]["kept"] == (key < 1_000) for key in found)


def test_traits_have_three_rules_and_patterns_are_counted_by_trait(spark, odd_docs):
    assert all(len(trait) == 3 and all(len(rule) == 3 for rule in trait.values()) for trait in RULES.values())
    found = cut_lineage(judged(odd_docs))
    passing = found.where("NOT base_failed").count()
    assert all(sum(counts.values()) == passing for _, counts in faults(found).values())


def test_columns_stay_and_empty_table(odd_docs, no_docs):
    assert keep_good(odd_docs).columns == odd_docs.columns
    assert quality(no_docs).collect() == []
    assert keep_good(no_docs).select(F.count("*")).first()[0] == 0
