"""Quality of documents by weak supervision: rules vote or abstain, and what their votes are worth is estimated.

Texts are judged on six traits, each by three rules that look at it from different sides and say good, bad, or nothing
where the figure is in between or cannot be taken. Whether a text has the fault of a trait is not known: it is the
hidden state that expectation-maximisation estimates, together with how common the fault is, how often each rule calls
sound texts bad and how often it catches the fault. Three votes on one hidden state are the fewest from which these
can be told: a rule that errs often is found out by the two others, and outvoted, whatever its name. A document is
good if it has none of the faults, and is kept when the probability of that, given all votes on it, is at least one half.

Texts are judged by DataFrame functions only. A trait has 27 vote patterns however large the corpus is; their counts
are all that estimation needs and all that comes to the driver, and the probabilities go back as literals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ref, require
from ..session import cut_lineage

WORD_BREAKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
ROUNDS = 500
SETTLED = 1e-7
#: A rule is taken to be better than chance, which is what tells the fault from its absence: it catches no less of its
#: own fault, and calls no more of the sound texts bad.
LEAST_HIT, MOST_FALSE = 0.6, 0.4
PSEUDO = 0.5  # rows of either outcome that every rate starts with; a constant, so evidence outweighs it in any corpus


class Fault(NamedTuple):
    """What is estimated of a trait: the share of faulty texts, and of each rule how often it votes bad."""

    share: float
    false: list[float]  # on sound texts
    hit: list[float]  # on faulty ones


def traits(text: Column) -> dict[str, Column]:
    """Steps of columns, each built on those before; to be added one after the other."""
    words = F.array_remove(F.split(text, WORD_BREAKS), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    hashes = F.transform(F.col("words"), lambda word: F.xxhash64(word))
    def joined(one: str, other: str, shift: int, count: Column) -> Column:
        """Hashes of each value of ``one`` with that of ``other`` ``shift`` places on."""
        return F.zip_with(F.slice(one, 1, count), F.slice(other, shift + 1, count), lambda x, y: F.xxhash64(x, y))

    long_, n = F.col("n_words") >= WINDOW, F.col("n_words").cast("int")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform(F.col("windows"), lambda value, i: F.struct(value.alias("v"), i.alias("i"))))
    again = F.filter(
        F.col("placed"),
        lambda here, i: (F.get("placed", i - 1)["v"] == here["v"]) | (F.get("placed", i + 1)["v"] == here["v"]),
    )
    starts = F.array_sort(F.transform(again, lambda here: here["i"]))
    covered = F.aggregate(
        F.col("starts"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda state, at: F.struct((at + WINDOW).alias("end"), (state["n"] + F.least(F.lit(WINDOW), at + WINDOW - state["end"])).alias("n")),
        lambda state: state["n"],
    )
    return {
        "words": words,
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "lines": lines,
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_hashes": hashes,
        "n_distinct": F.size(F.array_distinct("word_hashes")).cast("long"),
        #: a window of five words is a pair of pairs and the word behind them
        "pairs": F.when(long_, joined("word_hashes", "word_hashes", 1, n - 1)),
        "fours": F.when(long_, joined("pairs", "pairs", 2, n - 3)),
        "windows": F.when(long_, joined("fours", "word_hashes", 4, n - 4)).otherwise(F.array().cast("array<bigint>")),
        "placed": F.when(repeats, placed).otherwise(F.lit(None)),
        "starts": F.when(F.col("placed").isNotNull(), starts),
        "n_repeat_words": F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
        "n_shouts": F.regexp_count(text, F.lit("!")),
        #: a match goes on to the end of its word, so words are counted, each once; that a word starts here is asked
        #: last, where the rare character is found; letters are taken away by runs, several times faster than one by one
        "n_marked": F.regexp_count(text, F.lit(f"{SYMBOLS}[^\\x20\\x09-\\x0D]*")),
        "n_capital_words": F.regexp_count(text, F.lit("\\p{Lu}(?<![^\\x20\\x09-\\x0D]\\p{Lu})\\p{Lu}")),
        "n_number_words": F.regexp_count(text, F.lit("[0-9](?<![^\\x20\\x09-\\x0D][0-9])")),
        "n_long_words": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]{21}[^\\x20\\x09-\\x0D]*+")),
        "n_letters": F.length(text) - F.length(F.regexp_replace(text, "\\p{L}++", "")),
        "n_shout_runs": F.regexp_count(text, F.lit("!!+")),
        "n_stops": F.regexp_count(text, F.lit("[.?]")),
        "n_chars": F.length(text),
    }


Rule = tuple[str, str, str]
#: trait -> its rules: name -> (figure it looks at, good while, bad while), as SQL over the traits; otherwise it abstains.
RULES: Mapping[str, Mapping[str, Rule]] = {
    "signs": {
        "symbols": ("n_symbols / nullif(n_words, 0)", "< 0.05", "> 0.2"),
        "marked_words": ("n_marked / nullif(n_words, 0)", "< 0.05", "> 0.15"),
        "symbol_density": ("n_symbols / nullif(word_chars, 0)", "< 0.01", "> 0.03"),
    },
    "capitals": {
        "capitals": ("n_upper / nullif(word_chars, 0)", "< 0.25", "> 0.6"),
        "capital_words": ("n_capital_words / nullif(n_words, 0)", "< 0.15", "> 0.5"),
        "capital_letters": ("n_upper / nullif(n_letters, 0)", "< 0.3", "> 0.7"),
    },
    "shouting": {
        "shouts": ("n_shouts / nullif(n_words, 0)", "< 0.05", "> 0.25"),
        "shout_runs": ("n_shout_runs / nullif(n_words, 0)", "< 0.01", "> 0.05"),
        "shouted_ends": ("n_shouts / nullif(n_shouts + n_stops, 0)", "< 0.3", "> 0.8"),
    },
    "repetition": {
        "repeated_words": ("n_repeat_words / nullif(n_words, 0)", "< 0.1", "> 0.15"),
        "repeated_lines": ("n_dup_lines / nullif(n_words, 0)", "< 0.002", "> 0.02"),
        "variety": ("n_distinct / nullif(least(n_words, 200), 0)", "> 0.35", "< 0.15"),
    },
    "long_words": {
        "word_length": ("word_chars / nullif(n_words, 0)", "between 3 and 9", "> 14"),
        "long_words": ("n_long_words / nullif(n_words, 0)", "< 0.05", "> 0.2"),
        "spacing": ("word_chars / nullif(n_chars, 0)", "< 0.9", "> 0.94"),
    },
    "numbers": {
        "digits": ("n_digits / nullif(word_chars, 0)", "< 0.1", "> 0.4"),
        "number_words": ("n_number_words / nullif(n_words, 0)", "< 0.15", "> 0.4"),
        "letters": ("n_letters / nullif(word_chars, 0)", "> 0.75", "< 0.5"),
    },
}


def votes(rules: Mapping[str, Mapping[str, Rule]]) -> Column:
    """A word for each trait, of one character for each of its rules in turn: 1 good, 0 bad, - abstains."""
    def said(figure: str, good: str, bad: str) -> str:
        return f"CASE WHEN {figure} {bad} THEN '0' WHEN {figure} {good} THEN '1' ELSE '-' END"

    return F.expr(f"concat_ws(' ', {', '.join(f'concat({", ".join(said(*rule) for rule in trait.values())})' for trait in rules.values())})")


def faulty(pattern: str, fault: Fault) -> float:
    """The probability of the fault, given the votes on its trait. A rule that abstains says nothing."""
    odds = math.log(fault.share) - math.log1p(-fault.share)
    for vote, false, hit in zip(pattern, fault.false, fault.hit):
        if vote != "-":
            odds += math.log(hit / false) if vote == "0" else math.log((1 - hit) / (1 - false))
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def estimate(counts: Mapping[str, int], rules: int) -> Fault:
    """What a trait's vote patterns, each with its number of documents, say of the fault and the rules.

    The first guess takes the word of most rules that vote. Every further round takes the rates that are most likely
    under the last round's probabilities, within what a rule that is better than chance can have.
    """
    guess = {}
    for pattern in sorted(counts):
        bad, good = pattern.count("0"), pattern.count("1")
        guess[pattern] = 0.9 if bad > good else 0.5 if bad and bad == good else 0.01
    fault = Fault(0.5, [0.5] * rules, [0.5] * rules)
    for _ in range(ROUNDS):
        total = sum(counts.values())
        share = (sum(n * guess[pattern] for pattern, n in counts.items()) + PSEUDO) / (total + 2 * PSEUDO)
        false, hit = [], []
        for rule in range(rules):
            rows = {(vote, state): PSEUDO for vote in "10" for state in (0, 1)}
            for pattern, n in counts.items():
                if pattern[rule] != "-":
                    rows[pattern[rule], 0] += n * (1 - guess[pattern])
                    rows[pattern[rule], 1] += n * guess[pattern]
            false.append(min(rows["0", 0] / (rows["0", 0] + rows["1", 0]), MOST_FALSE))
            hit.append(max(rows["0", 1] / (rows["0", 1] + rows["1", 1]), LEAST_HIT))
        last, fault = fault, Fault(share, false, hit)
        guess = {pattern: faulty(pattern, fault) for pattern in guess}
        if max(abs(a - b) for a, b in zip([share, *false, *hit], [last.share, *last.false, *last.hit])) < SETTLED:
            break
    return fault


def judged(docs: DataFrame, text_column: str = "text", rules: Mapping[str, Mapping[str, Rule]] = RULES) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, pattern): ``row`` holds all
    columns of ``docs`` as a struct, so none of their names can clash."""
    require(docs, text_column)
    found = docs.select(F.struct(*[ref(name) for name in docs.columns]).alias("row"), F.coalesce(ref(text_column).cast("string"), F.lit("")).alias("text"))
    for name, column in traits(F.col("text")).items():
        found = found.withColumn(name, column)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("row", *counted, failed.alias("base_failed"), votes(rules).alias("pattern"))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability, votes).

    The base figures are over whole texts: words ``[^\\x20\\x09-\\x0D]+``, code points in words, characters of
    ``#*$%&|<>``, lines with a word that equal an earlier one, words in 5-word windows that occur twice or more.
    ``base_failed``: fewer than 10 words, or more than a fifth of them repeated; such rows are not kept and take no
    part in the estimate. A null or empty text has no words and fails. Null ids and repeated rows come back as they
    are; other columns are not read. An empty table gives an empty result.
    """
    require(docs, id_column, text_column)
    slim = docs.select(ref(id_column).alias("id"), ref(text_column).alias("text"))
    found = cut_lineage(judged(slim).withColumn("id", F.col("row.id")).drop("row"))
    return _decided(found, "id").withColumnRenamed("id", id_column)


def faults(found: DataFrame, rules: Mapping[str, Mapping[str, Rule]] = RULES) -> dict[str, tuple[Fault, dict[str, int]]]:
    """What is estimated of each trait, and the counts of vote patterns it comes from, over the rows of :func:`judged`
    that pass the base rule. ``found`` should be at rest, or texts are judged again."""
    patterns = found.where("NOT base_failed").groupBy("pattern").agg(F.count("*").alias("n"))
    by_trait = patterns.select(F.posexplode(F.split("pattern", " ")).alias("trait", "said"), "n").groupBy("trait", "said").agg(F.sum("n").alias("n"))
    counts: list[dict[str, int]] = [{} for _ in rules]
    for trait, said, n in by_trait.collect():  # at most 27 rows for each trait
        counts[trait][said] = n
    return {name: (estimate(of, len(rules[name])), of) for name, of in zip(rules, counts)}


def _decided(found: DataFrame, *first: str) -> DataFrame:
    good = F.lit(1.0)
    for place, (fault, counts) in enumerate(faults(found).values()):
        worth = [F.lit(value) for said in sorted(counts) for value in (said, 1 - faulty(said, fault))]
        if worth:
            good = good * F.element_at(F.create_map(*worth), F.get(F.split("pattern", " "), F.lit(place)))
    probability = F.when(~F.col("base_failed"), F.round(good, 9))
    return found.withColumn("probability", probability).select(
        *first, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("probability") >= 0.5)).alias("kept"), "probability", F.col("pattern").alias("votes"),
    )


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns.

    Null and empty texts have no words, fail the base rule and go; texts of any length are judged whole. Repeated rows
    all stay or all go; nulls in other columns and names of any kind do not matter. An empty table gives an empty result.
    """
    found = cut_lineage(judged(docs, text_column))
    return _decided(found, "row").where("kept").select("row.*")
