"""From lines to the lines that count: duplicates resolved, fork copies marked, prompts found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlake.ingest.records import (
    BLOCK_KINDS,
    MACHINE_TAGS,
    TURN_TAGS,
    words_of,
)
from sessionlake.operators.windows import THREAD, block_of, running
from sessionlake.schema import MAIN

LINE = [*THREAD, "line_no"]


def reject(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("session_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def place(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def noted(lines: DataFrame) -> DataFrame:
    """Parsed lines with what deciding between them takes, a few short columns, and not what they hold.

    `row` names a line for good once these are kept: two lines of one place are still two."""
    said = F.when(F.col("kind").isin("user", "assistant"), F.md5(F.col("rec.message.content")))
    odd_block = F.size(F.filter("blocks", lambda b: ~b["type"].isin(*BLOCK_KINDS))) > 0
    return with_prompts(lines).select(
        F.monotonically_increasing_id().alias("row"), *LINE, "raw", "uuid", "kind", "ts",
        F.col("rec").isNotNull().alias("readable"), F.coalesce(said, F.lit("-")).alias("said"),
        F.col("prompt").isNotNull().alias("opens"), "odd_tag", odd_block.alias("odd_block"),
    )


def unreadable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cut tails, damage): a last line still being written is dropped, an earlier one is damage."""
    bad = lines.filter(~F.col("readable")).select(*LINE)
    last = lines.groupBy(*THREAD).agg(F.max("line_no").alias("last_no"))
    held = bad.join(last, THREAD)
    tails = held.filter(F.col("line_no") == F.col("last_no")).select(*LINE)
    broken = held.filter(F.col("line_no") < F.col("last_no"))
    return tails, reject(broken, "unparseable line", place("source", "line_no"))


def resolve_duplicates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept lines, conflicts): a uuid written twice in one file keeps its last line.

    Only repeated uuids are looked up again, so the lines themselves meet a short list.
    """
    repeated = (
        lines.filter(F.col("uuid").isNotNull())
        .groupBy(*THREAD, "uuid")
        .agg(
            F.max("line_no").alias("last_no"), F.count(F.lit(1)).alias("n"),
            F.min("said").alias("lo"), F.max("said").alias("hi"),
        )
        .filter(F.col("n") > 1)
    )
    conflicts = reject(
        repeated.filter(F.col("lo") != F.col("hi")), "uuid with two contents",
        place("source", "uuid"),
    )
    earlier = (
        lines.select(*LINE, "uuid")
        .join(repeated.select(*THREAD, "uuid", "last_no"), [*THREAD, "uuid"])
        .filter(F.col("line_no") < F.col("last_no"))
        .select(*LINE)
    )
    return lines.join(earlier, LINE, "left_anti"), conflicts


def transcript_order(lines: DataFrame, metas: DataFrame) -> DataFrame:
    """Every transcript with the key that says which of a session's was first to record a line."""
    threads = lines.groupBy(*THREAD).agg(F.min("ts").alias("first_ts"))
    depth = metas.select("session_id", F.col("agent_id").alias("source"), "spawnDepth", "isFork")
    unknown = F.lit(2**31 - 1)
    late = F.timestamp_micros(F.lit(2**62))
    return threads.join(depth, THREAD, "left").select(
        *THREAD, F.coalesce("isFork", F.lit(False)).alias("is_fork"),
        F.struct(
            (F.col("source") != MAIN).alias("run"),
            F.coalesce("spawnDepth", unknown).alias("depth"),
            F.coalesce("first_ts", late).alias("first_ts"), F.col("source").alias("source"),
        ).alias("order"),
    )


def replays(lines: DataFrame, metas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, errors): a uuid belongs to the first transcript of its session that records it.

    Only uuids seen in two transcripts are ranked. A copy outside a fork is an error.
    """
    held = lines.filter(F.col("uuid").isNotNull()).select(*THREAD, "uuid")
    shared = (
        held.groupBy("session_id", "uuid")
        .agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("session_id", "uuid")
    )
    ranked = (
        held.join(shared, ["session_id", "uuid"], "left_semi")
        .distinct()
        .join(transcript_order(lines, metas), THREAD)
    )
    owner = ranked.groupBy("session_id", "uuid").agg(F.min("order").alias("first"))
    copies = ranked.join(owner, ["session_id", "uuid"]).filter(
        F.col("source") != F.col("first.source")
    )
    errors = reject(copies.filter(~F.col("is_fork")), "replay outside a fork", place("source", "uuid"))
    return copies.select(*THREAD, "uuid"), errors


def mark_replays(lines: DataFrame, copies: DataFrame) -> DataFrame:
    marked = copies.withColumn("_copy", F.lit(True))
    return (
        lines.join(marked, [*THREAD, "uuid"], "left")
        .withColumn("replayed", F.coalesce("_copy", F.lit(False)))
        .drop("_copy")
    )


_TAG = r"^<([A-Za-z0-9_-]+)(?=[\s>])"


def _captured(tag: str, content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(1)))


def with_prompts(lines: DataFrame) -> DataFrame:
    """Lines with the prompt each opens, and whether one begins with an unknown tag.

    A user record opens a turn unless it is the machine's own, a summary, a side chain on the main
    thread, or carries a tool's result back.
    """
    content = F.col("rec.message.content")
    listed = F.col("blocks").isNotNull()
    own = (
        (F.col("kind") == "user")
        & ~F.coalesce(F.col("rec.isMeta"), F.lit(False))
        & ~F.coalesce(F.col("rec.isCompactSummary"), F.lit(False))
        & ~((F.col("source") == MAIN) & F.coalesce(F.col("rec.isSidechain"), F.lit(False)))
    )
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    tagged = text.startswith("<")
    tag = F.regexp_extract(text, _TAG, 1)

    def holds(*kinds: str) -> Column:
        return F.exists("blocks", lambda b: b["type"].isin(*kinds))

    opens_blocks = listed & ~holds("tool_result") & holds("text", "image")
    opens_text = ~listed & (text != "") & (~tagged | tag.isin(*TURN_TAGS))
    prompt = F.when(own & opens_blocks, words_of(F.col("blocks"), "text", "text")).when(
        own & opens_text, content
    )
    command = own & opens_text & tagged
    odd = own & ~listed & tagged & ~tag.isin(*TURN_TAGS) & ~tag.isin(*MACHINE_TAGS)
    return lines.withColumns(
        {
            "prompt": prompt,
            "command_name": F.when(command, _captured("command-name", content)),
            "command_args": F.when(command, _captured("command-args", content)),
            "odd_tag": odd,
        }
    )


def unknown_tags(lines: DataFrame) -> DataFrame:
    return reject(lines.filter("odd_tag"), "unknown leading tag", place("source", "line_no"))


def assign_turns(lines: DataFrame) -> DataFrame:
    """Every line with the turn open where it stands: the latest prompt at or above it."""
    opens = F.col("opens")
    return running(
        lines, THREAD, block_of(F.col("line_no")), ["line_no"],
        counts={"turn_no": opens}, lasts={"turn_id": F.when(opens, F.col("uuid"))},
    )


def unknown_blocks(lines: DataFrame) -> DataFrame:
    """Content of a kind nothing reads: taking it for nothing would hide what a session did."""
    return reject(lines.filter("odd_block"), "unknown content block", place("source", "line_no"))
