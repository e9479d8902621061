"""Operators over log tables: question logs, event traces, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import strip
from millrace.schema import ref

# Intents and the words that select them; the first match wins.
INTENT_WORDS = {
    "analysis_and_visualization": ("chart", "plot", "graph", "visualize", "trend", "show me", "draw"),
    "insights": ("insight", "pattern", "discover", "anomaly", "unusual", "why"),
    "profiling": ("profile", "profiling", "schema", "describe", "overview", "summary", "shape"),
    "quality_check": ("quality", "missing", "duplicate", "outlier", "readiness", "imbalance"),
    "cleaning_report": ("clean", "preprocess", "fix data", "repair"),
}
NO_INTENT = "analysis_only"

# Patterns that block a question, matched without regard to case.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+(all\s+)?above",
    r"you\s+are\s+now\s+a",
    r"pretend\s+(you\s+are|to\s+be)",
    r"forget\s+(everything|all|your\s+(instructions|guidelines|rules))",
    r"disregard\s+(all|your|the)\s+(rules|instructions|guidelines)",
    r"act\s+as\s+(if|though|a\s+)\b",
    r"new\s+instruction[s]?\s*:",
    r"system\s*prompt\s*:",
    r"override\s+(your|the)\s+(rules|instructions)",
    r"do\s+not\s+follow\s+(your|the)\s+(rules|instructions)",
    r"reveal\s+(your|the)\s+(system|initial)\s+prompt",
    r"what\s+(is|are)\s+your\s+(system|initial)\s+(prompt|instructions)",
    r"repeat\s+(your|the)\s+(system|initial)\s+(prompt|instructions)",
    r"jailbreak",
    r"DAN\s+mode",
)
CODE_PATTERNS = (
    r"import\s+os\b",
    r"import\s+subprocess\b",
    r"os\.system\s*\(",
    r"subprocess\.(run|call|Popen)",
    r"rm\s+-rf\b",
    r"DROP\s+TABLE\b",
    r"DELETE\s+FROM\b",
    r";\s*--",
    r"UNION\s+SELECT\b",
)
SHORTEST_QUESTION, LONGEST_QUESTION = 3, 2000
TRACE_LIMIT, TRACE_MOST = 50, 200
#: Turns per block when a conversation is split between tasks.
TURNS_PER_BLOCK = 4096


def intent(text: Column) -> Column:
    """Intent of a question by the first list with a word in it."""
    lowered = F.lower(text)
    tagged = None
    for name, words in INTENT_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        tagged = F.when(hit, name) if tagged is None else tagged.when(hit, name)
    return tagged.otherwise(NO_INTENT)


def tag_intents(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("intent", intent(ref(text)))


def guardrail(text: Column) -> Column:
    """``ok``, or why a question is blocked: too_short, too_long, injection, code."""
    question = strip(text)
    return (
        F.when(F.length(question) < SHORTEST_QUESTION, "too_short")
        .when(F.length(question) > LONGEST_QUESTION, "too_long")
        .when(question.rlike(f"(?i){'|'.join(INJECTION_PATTERNS)}"), "injection")
        .when(question.rlike(f"(?i){'|'.join(CODE_PATTERNS)}"), "code")
        .otherwise("ok")
    )


def scan_guardrails(df: DataFrame, text: str) -> DataFrame:
    verdict = guardrail(ref(text))
    return df.withColumn("reason", verdict).withColumn("allowed", F.col("reason") == "ok")


def summarise_traces(
    events: DataFrame, trace: Column, user: str, time: str, failed: Column, limit: int = TRACE_LIMIT
) -> DataFrame:
    """Per trace its start, duration, success and event count; the newest ``limit`` per user.

    Events are combined per task before the shuffle, and the newest per user are chosen
    per task before theirs, so neither a long trace nor a busy user gathers in one task.
    """
    if limit > TRACE_MOST:
        raise ValueError(f"at most {TRACE_MOST} traces of a user")
    traces = events.groupBy(ref(user).alias("user"), trace.alias("trace")).agg(
        F.min(ref(time)).alias("started_at"),
        F.max(ref(time)).alias("ended_at"),
        F.count("*").alias("event_count"),
        (F.count_if(failed) == 0).alias("success"),
    )
    newest = Window.partitionBy("user").orderBy(F.desc("started_at"), "trace")
    duration = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("ended_at"))
    return (
        traces.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit)
        .withColumn("duration_ms", duration)
        .drop("ended_at")
    )


def trace_totals(traces: DataFrame) -> DataFrame:
    """One row: average duration, successful and failed traces."""
    return traces.agg(
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def with_neighbours(
    df: DataFrame, group: str, order: str, before: dict[str, Column], after: dict[str, Column], block: int = TURNS_PER_BLOCK
) -> DataFrame:
    """Add fields of the previous (``before``) and next (``after``) row of the group.

    A group is cut into blocks of its integer ``order``, so a group that holds a third
    of the table spreads over many tasks. Only groups of several blocks look across
    blocks: each of their blocks gets the last row of the block before it and the first
    row of the next. When the whole table lies in one block there is nothing to join.
    """
    block_no = F.floor(ref(order) / block)
    earlier = F.struct(*[value.alias(name) for name, value in before.items()])
    later = F.struct(*[value.alias(name) for name, value in after.items()])
    blocked = df.withColumn("__block", block_no)
    inside = Window.partitionBy(ref(group), "__block").orderBy(ref(order))
    seen = blocked.withColumn("before", F.lag(earlier).over(inside)).withColumn("after", F.lead(later).over(inside))
    reach = df.agg(F.min(block_no).alias("first"), F.max(block_no).alias("last")).first()
    if reach["first"] == reach["last"]:
        return seen.drop("__block")

    long_groups = (
        blocked.groupBy(ref(group))
        .agg((F.min("__block") < F.max("__block")).alias("several"))
        .where("several")
        .select(ref(group).alias("__group"))
    )
    blocks = Window.partitionBy("__group").orderBy("__edge")
    edges = (
        blocked.join(long_groups, ref(group).eqNullSafe(F.col("__group")), "left_semi")
        .groupBy(ref(group).alias("__group"), F.col("__block").alias("__edge"))
        .agg(F.max_by(earlier, ref(order)).alias("__last"), F.min_by(later, ref(order)).alias("__first"))
        .withColumn("__from_before", F.lag("__last").over(blocks))
        .withColumn("__from_after", F.lead("__first").over(blocks))
        .drop("__last", "__first")
    )
    at_edge = ref(group).eqNullSafe(F.col("__group")) & F.col("__block").eqNullSafe(F.col("__edge"))
    return seen.join(edges, at_edge, "left").select(
        *[ref(c) for c in df.columns],
        F.coalesce("before", "__from_before").alias("before"),
        F.coalesce("after", "__from_after").alias("after"),
    )


def pair_turns(
    messages: DataFrame, conversation: str, turn: str, role: str, text: str, block: int = TURNS_PER_BLOCK
) -> DataFrame:
    """Question and answer pairs, in conversation order.

    A user message followed by an answer makes a pair; a last unanswered question gets
    an empty answer; a question followed by another question is dropped; an answer
    without a question keeps a null question. Other roles are not part of the exchange.
    """
    speaker = F.when(ref(role) == "user", "user").when(ref(role).isin("assistant", "agent"), "assistant")
    said = messages.withColumn("__speaker", speaker).where(F.col("__speaker").isNotNull())
    seen = with_neighbours(
        said, conversation, turn,
        before={"speaker": F.col("__speaker"), "text": ref(text)},
        after={"speaker": F.col("__speaker")},
        block=block,
    )
    is_answer = F.col("__speaker") == "assistant"
    return seen.where(is_answer | F.col("after").isNull()).select(
        ref(conversation),
        ref(turn),
        F.when(~is_answer, ref(text)).when(F.col("before.speaker") == "user", F.col("before.text")).alias("question"),
        F.when(is_answer, ref(text)).otherwise("").alias("answer"),
    )
