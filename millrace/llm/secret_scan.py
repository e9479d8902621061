"""Secrets in texts, told apart by who else has them.

A credential in a text is worth an alarm if it is somebody's; most strings of that form are examples that documentation,
tutorials and forks carry around. So candidates are found by their form, text by text, and then looked at over the whole
corpus: the hash of a candidate's value is counted by distinct repositories and distinct owners. A value that many owners
have is widely copied, whatever it looks like; one that looks live and stays with few owners is theirs.

Only hashes and places leave a task, never the values. Counting is two aggregations that combine within the tasks first:
rows to (hash, owner, repository), those to (hash, owner), those to hashes. Verdicts go back to the candidates by a join;
hashes with more than a ten-thousandth of all candidates, of which there can't be more than ten thousand, are broadcast
for it, so none of those left is hot.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ref, require
from ..session import cut_lineage, scratch_path
from .common import arrow_map

#: The base kinds in their order, each with its pattern, the group that is the secret, and its least length.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the first 24 of a stretch can only begin where the stretch does
}
#: Formats that public services document for their credentials.
FORMATS: dict[str, tuple[str, int, int]] = {
    "vendor": (r"\b(?:gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1),
    "url": (r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@", 1, 6),
    "private_key": (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]{64,})-----END", 1, 64),
}
#: Words that values of examples are made of.
PLACEHOLDERS = re.compile("example|sample|dummy|changeme|change_me|placeholder|password|secret|redacted|your|xxxx|test|abcdef|qwerty|123456|<|\\*\\*", re.ASCII | re.IGNORECASE)
LEAST_LIVE, LEAST_BITS = 12, 2.5  # characters of a live-looking value, and bits a character
MANY_OWNERS = 3
HOT_SHARE = 10_000
KINDS = [*BASE, *FORMATS]
LIVE = len(KINDS)  # of the spans that the verdict adds; its name follows those of all kinds
NAMES = [*KINDS, "live"]

SPAN = "struct<kind: int, start: bigint, end: bigint>"
CANDIDATE = "struct<kind: int, start: bigint, end: bigint, value_start: bigint, value_end: bigint, hash: string, plausible: boolean>"
ARROW_FOUND = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("hash", pa.string()), ("plausible", pa.bool_())]
    )
)
PATTERNS = [(number, re.compile(pattern, re.ASCII), group, least) for number, (pattern, group, least) in enumerate([*BASE.values(), *FORMATS.values()])]
#: Something that each match holds, in lower case, by kind: most texts hold none of it, and a search for it is quick.
NEEDED = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "vendor": ("gh", "glpat-", "xox", "k_live_", "aiza"), "jwt": ("eyj",), "url": ("://",), "private_key": ("-----begin",)}


def looks_live(value: str) -> bool:
    """Long enough, of letters and digits mixed, with as many bits a character as random strings have, no placeholder."""
    if len(value) < LEAST_LIVE or PLACEHOLDERS.search(value):
        return False
    if not (any(letter.isdigit() for letter in value) and any(letter.isalpha() for letter in value)):
        return False
    shares = [n / len(value) for n in Counter(value).values()]
    return -sum(share * math.log2(share) for share in shares) >= LEAST_BITS


def candidates_in(text: str) -> list[dict]:
    """All candidates of a text by place and kind; of each kind the leftmost matches that do not overlap."""
    found, lower = [], text.lower()
    for kind, pattern, group, least in PATTERNS:
        needed = NEEDED.get(KINDS[kind])
        if needed and not any(part in lower for part in needed):
            continue
        for match in pattern.finditer(text):
            value = match[group]
            if len(value) >= least:
                digest = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
                places = (match.start(), match.end(), match.start(group), match.end(group))
                found.append((match.start(), kind, places, digest, looks_live(value)))
    return [
        {"kind": kind, "start": places[0], "end": places[1], "value_start": places[2], "value_end": places[3], "hash": digest, "plausible": plausible}
        for _, kind, places, digest, plausible in sorted(found)
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [candidates_in(text.as_py()) for text in batch.column(1)]
        yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(found, ARROW_FOUND)], names=["id", "owner", "repository", "found"])


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source", repository_column: str = "doc_id") -> DataFrame:
    """(row, id, owner, repository, found): the candidates of each row of ``docs``, written once; ``row`` numbers the rows."""
    require(docs, id_column, text_column, owner_column, repository_column)
    text = F.coalesce(ref(text_column).cast("string"), F.lit(""))
    slim = docs.select(ref(id_column).alias("id"), text.alias("text"), ref(owner_column).cast("string").alias("owner"), ref(repository_column).cast("string").alias("repository"))
    kind = slim.schema["id"].dataType.simpleString()
    found = arrow_map(slim, _scan, f"id {kind}, owner string, repository string, found array<{CANDIDATE}>")
    path = scratch_path(docs.sparkSession, "secrets")
    found.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _each(found: DataFrame) -> DataFrame:
    return found.select("row", "owner", "repository", F.inline("found"))


def ownership(found: DataFrame, many_owners: int = MANY_OWNERS) -> DataFrame:
    """(hash, n_rows, n_repositories, n_owners, verdict) of each live-looking value in ``found`` of :func:`candidates`.

    ``verdict`` is ``example`` where ``many_owners`` or more distinct owners have the value, otherwise ``live``. A
    repository is one of its owner's; null is an owner, and a repository, like any other.
    """
    by_repository = _each(found).where("plausible").groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    counted = by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
    return counted.withColumn("verdict", F.when(F.col("n_owners") >= many_owners, "example").otherwise("live"))


def with_verdicts(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(row, value_start, value_end, verdict, n_owners, n_repositories) of each live-looking candidate."""
    places = _each(found).where("plausible").select("row", "value_start", "value_end", "hash")
    told = cut_lineage(verdicts)
    total = told.agg(F.sum("n_rows")).first()[0] or 0
    is_hot = F.col("n_rows") > total / HOT_SHARE
    columns = ["row", "value_start", "value_end", "verdict", "n_owners", "n_repositories"]
    hot = F.broadcast(told.where(is_hot))  # fewer than HOT_SHARE hashes can have more than that share of all rows
    common = places.join(hot, "hash").select(*columns)
    rare = places.join(F.broadcast(told.where(is_hot).select("hash")), "hash", "left_anti").join(told.where(~is_hot), "hash").select(*columns)
    return common.unionByName(rare)


def secret_spans(
    docs: DataFrame, many_owners: int = MANY_OWNERS, id_column: str = "doc_id", text_column: str = "text",
    owner_column: str = "source", repository_column: str = "doc_id",
) -> DataFrame:
    """(id, spans, n_live, n_example) for each row of ``docs``, the id under its own name.

    ``spans`` are structs of kind (a place in ``NAMES``), start and end (code points, end exclusive), by start, kind and
    end: all matches of the base kinds, and one of kind ``live`` on the value of every candidate, of a base kind or a
    documented format, that looks live and that fewer than ``many_owners`` owners have. ``n_example`` counts the
    live-looking values that are widely copied; they get no span of their own.

    Null and empty texts have no spans. Null ids and repeated rows come back as they are, each with its own spans. Texts
    of any length are read whole. Columns that are not named are not read. An empty table gives an empty result.
    """
    found = candidates(docs, id_column, text_column, owner_column, repository_column)
    told = with_verdicts(found, ownership(found, many_owners))
    live = F.struct(F.lit(LIVE).alias("kind"), F.col("value_start").alias("start"), F.col("value_end").alias("end"))
    place = F.struct("value_start", "value_end")
    added = told.groupBy("row").agg(
        F.collect_set(F.when(F.col("verdict") == "live", live)).alias("added"),
        F.count_distinct(F.when(F.col("verdict") == "example", place)).alias("n_example"),
    )
    base = F.transform(F.filter("found", lambda span: span["kind"] < len(BASE)), lambda span: F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end")))
    added_or_none = F.coalesce("added", F.array().cast(f"array<{SPAN}>"))
    by_place = F.transform(F.concat(base, added_or_none), lambda span: F.struct(span["start"], span["kind"], span["end"]))
    spans = F.transform(F.array_sort(by_place), lambda span: F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end")))
    joined = found.select("row", "id", "found").join(added, "row", "left")
    return joined.select(F.col("id").alias(id_column), spans.alias("spans"), F.size(added_or_none).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def span_text(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", F.get(names, span["kind"]), span["start"].cast("string"), span["end"].cast("string"))), ",")
