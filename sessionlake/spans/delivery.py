"""What is still to be sent to a tracing back end, how much that is, and the ledger of what was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake import schema
from sessionlake.operators.relations import Tables
from sessionlake.session import keep
from sessionlake.sources.commits import check_atomic, create, file_system
from sessionlake.spans.spans import BATCH_SPANS, COMPACTION_SPAN, MAPPER_VERSION, spans


def undelivered(t: Tables, backend: str, mapper_version: str = MAPPER_VERSION) -> DataFrame:
    """Sessions whose files or whose mapping changed since they were last sent to a back end."""
    sent = t["span_delivery"].filter(F.col("backend") == backend).select(
        "session_id", F.col("fingerprint").alias("sent"), "mapper_version"
    )
    same = (F.col("fingerprint") == F.col("sent")) & (F.col("mapper_version") == mapper_version)
    return (
        t["extract_state"].select("session_id", "fingerprint")
        .join(sent, "session_id", "left")
        .filter(~F.coalesce(same, F.lit(False)))
        .select("session_id", "fingerprint")
    )


def census(t: Tables, backend: str) -> DataFrame:
    """How many sessions, spans and compactions a send would ship."""
    due = undelivered(t, backend).select("session_id")
    rows = spans(t).join(due, "session_id", "left_semi")
    per_session = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("name") == COMPACTION_SPAN).alias("compactions"),
    )
    return per_session.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"),
        F.coalesce(F.sum("compactions"), F.lit(0)).alias("compactions"),
    )


class Outbox:
    """Spans handed to a back end as files of bounded batches, each session's spans once.

    A send writes its spans and, counted from what it wrote, its ledger rows, both under an id of its own;
    then one file put in place under the next number names the id. What no such file names does not
    exist for readers, so a send that dies before has sent nothing and one that dies after is done: the
    next send asks the same ledger what is due. Of two sends at once the later finds its number taken
    and goes on only if the other has sent none of its sessions.
    """

    def __init__(self, spark: SparkSession, folder: str, backend: str, one_writer: bool = False) -> None:
        self.spark, self.folder, self.backend = spark, folder.rstrip("/"), backend
        check_atomic(spark, self.folder, one_writer)

    def _commits(self) -> DataFrame:
        """(number, send_id) of the sends that are done, as many as there were."""
        path, files = file_system(self.spark, f"{self.folder}/commits")
        if not files.exists(path):
            return self.spark.createDataFrame([], "number long, send_id string")
        # Named by number alone, so that a number can be taken only once.
        return self.spark.read.text(f"{self.folder}/commits").select(
            F.col("_metadata.file_name").cast("long").alias("number"), F.col("value").alias("send_id")
        )

    def _done(self, name: str, shape: T.StructType) -> DataFrame:
        path, files = file_system(self.spark, f"{self.folder}/{name}")
        if not files.exists(path):
            return self.spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("number", T.LongType())]))
        named = T.StructType([*shape.fields, T.StructField("send_id", T.StringType())])
        rows = self.spark.read.schema(named).parquet(f"{self.folder}/{name}")
        return rows.join(self._commits(), "send_id").drop("send_id")

    def spans(self, shape: T.StructType) -> DataFrame:
        """All spans sent, also those of a session's earlier states."""
        return self._done("spans", shape).drop("number")

    def ledger(self) -> DataFrame:
        """What each session was last sent as."""
        rows = self._done("ledger", schema.ALL_TABLES["span_delivery"])
        last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("session_id", "number")]), "number")
        return rows.groupBy("session_id").agg(last.alias("last")).select("session_id", "last.*")

    def send(self, t: Tables, tries: int = 5) -> DataFrame | None:
        """Sends what is due by the store's ledger and this one, and answers the rows that say so."""
        for _ in range(tries):
            begun = self._commits().agg(F.max("number")).first()[0] or 0
            held = t["span_delivery"].filter(F.col("backend") == self.backend)
            mine = self.ledger().select(held.columns)
            known = held.join(mine.select("session_id"), "session_id", "left_anti").select(held.columns)
            asked = Tables({**t.frames, "span_delivery": known.unionByName(mine)})
            due = keep(undelivered(asked, self.backend), "due")
            if due.isEmpty():
                return None
            send_id = uuid.uuid4().hex
            place = f"{self.folder}/spans/send_id={send_id}"
            rows = spans(t).join(due.select("session_id"), "session_id", "left_semi")
            rows.write.option("maxRecordsPerFile", BATCH_SPANS).parquet(place)
            counts = self.spark.read.schema(rows.schema).parquet(place).groupBy("session_id").agg(
                F.count(F.lit(1)).alias("spans_sent")
            )
            said = due.join(counts, "session_id").select(
                "session_id", F.lit(self.backend).alias("backend"), "fingerprint",
                F.lit(MAPPER_VERSION).alias("mapper_version"), "spans_sent",
                F.current_timestamp().alias("delivered_at"),
            )
            said.write.parquet(f"{self.folder}/ledger/send_id={send_id}")
            said = self.spark.read.schema(said.schema).parquet(f"{self.folder}/ledger/send_id={send_id}")
            if said.isEmpty():  # sessions without a start have no spans and stay due
                return None
            number = begun + 1
            while not create(self.spark, f"{self.folder}/commits", f"{number:012d}", send_id):
                others = self._done("ledger", schema.ALL_TABLES["span_delivery"]).filter(F.col("number") > begun)
                if not others.join(said.select("session_id"), "session_id", "left_semi").isEmpty():
                    break  # another send had some of these sessions first: ask anew what is due
                number += 1
            else:
                return said
        raise RuntimeError(f"{self.folder}: {tries} sends were overtaken")


def send(t: Tables, backend: str, folder: str) -> DataFrame | None:
    """Sends what is due to a back end's outbox; the ledger rows of what was sent."""
    return Outbox(t["extract_state"].sparkSession, folder, backend).send(t)
