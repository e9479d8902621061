"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontaminate import contaminated
from .mixing import mixture
from .near_dup import near_duplicates
from .periodic_runs import periodic_runs, with_repeats
from .pii import pseudonymised
from .quality_vote import quality
from .secret_scan import BASE, secret_spans, span_text
from .sharding import sharded
from .token_alignment import aligned
from .token_counts import token_counts
from .token_files import read_digests, write_token_files
from .toxicity import toxicity
from .warc import resolve, write_archives


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=2)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), limit=1024)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_digests(write_token_files(table(spark, folder, "documents"), end=2))


def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(table(spark, folder, "documents"), shards=24)


def op8_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return resolve(write_archives(table(spark, folder, "pages")))


def op9_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymised(documents, key="millrace", count_column="n_replaced")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the documents, a tenth of which are made to repeat words of theirs, as digests."""
    docs = table(spark, folder, "documents")
    listed = docs.select("doc_id", "text", F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    drawn = listed.withColumns({"n": F.size("words"), "h": F.crc32(F.col("doc_id").cast("string"))}).withColumn("g", F.expr("h div 10"))
    drawn = drawn.withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), (F.col("g") % F.col("n")).cast("int")))
    drawn = drawn.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(with_repeats(F.col("words"), F.col("a"), F.col("p")))
    found = periodic_runs(drawn.select("doc_id", text.alias("text")))

    def written(run: Column) -> Column:
        return F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string"))

    ordered = F.array_sort(F.transform("runs", lambda run: F.struct(run["start"], run["period"], run["length"])))
    lines = F.transform(ordered, lambda run: F.concat(written(run), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("start"), (-run["period"]).alias("period"))))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned(table(spark, folder, "documents"))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of the documents; a document stands for a repository, and its source for the owner."""
    found = secret_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda span: span["kind"] < len(BASE))

    def count_of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long")

    counts = [count_of(kind).alias(f"n_{name}") for kind, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text("spans").alias("spans"), "n_live", "n_example")


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_mixture": op4_mixture,
    "op5_contamination": op5_contamination,
    "op6_quality": op6_quality,
    "op7_shards": op7_shards,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_secrets": op13_secrets,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text, as a list.
WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE = {
    "op1_near_duplicates": f"""
        WITH RECURSIVE lists AS (
            SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS words FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
                ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS shingle
            FROM lists
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
        ), half AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
        ), links AS (
            SELECT a, b FROM half UNION ALL SELECT b, a FROM half
        ), reach AS (
            SELECT doc_id AS start, doc_id AS stop FROM documents
            UNION SELECT start, b FROM reach JOIN links ON stop = a
        ), roots AS (
            SELECT start AS doc_id, min(stop) AS component_id FROM reach GROUP BY start
        )
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
    """,
    "op4_mixture": f"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len({WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size FROM documents
        ), queued AS (
            SELECT *, sum(size) OVER (PARTITION BY source) AS source_size, sum(size) OVER (PARTITION BY source
                ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
            FROM sized
        ), sources AS (
            SELECT source, CAST(sum(size) AS DOUBLE) AS total, 2 * CAST(sum(size) AS DOUBLE) AS cap,
                CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM sized GROUP BY source
        ), filled AS (
            SELECT *, CAST(1.5 AS DOUBLE) * sum(total) OVER () AS budget,
                sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS before,
                sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS after
            FROM sources
        ), capped AS (
            SELECT *, cap <= (budget - before) * weight / after AS is_capped FROM filled
        ), targets AS (
            SELECT source, CASE WHEN is_capped THEN cap ELSE (budget - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0))
                * weight / sum(CASE WHEN NOT is_capped THEN weight END) OVER () END AS target
            FROM capped
        )
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
            CAST(greatest(0, least(size, floor(target) - ahead))
                + greatest(0, least(size, floor(target) - source_size - ahead)) AS BIGINT) AS taken
        FROM queued JOIN targets ON queued.source IS NOT DISTINCT FROM targets.source
    """,
    "op8_warc_revisits": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM firsts
    """,
}
