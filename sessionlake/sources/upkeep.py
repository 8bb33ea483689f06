"""What an archive keeps up with each write: who held an id first, and the counts of every session.

A write concerns the ids its sessions had and those they have now. Whoever else holds one of these is found
in `id_holders`, which is in buckets by id; the first of an id's holders may change, also because one is
gone, so what each of them has copied of these ids is decided anew, and the counts of the sessions
concerned are counted anew from their own rows. Nothing else is read: a report takes copies and counts as
they stand, and neither it nor the write grows with the archive.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.operators.relations import Tables, rollups
from sessionlake.session import keep

if TYPE_CHECKING:
    from sessionlake.sources.store import Store

#: The relations whose ids a resumed session repeats, and all that counts of sessions are made of.
COPIED = schema.COUNTED
COUNTS = ["sessions", *COPIED]


def _shaped(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.DERIVED[name].fields])


def _ids(t: Tables) -> DataFrame:
    """(session_id, relation, id) of everything that counts for a session."""
    parts = [t.live(name).select("session_id", F.lit(name).alias("relation"), "id") for name in COPIED]
    return reduce(DataFrame.unionByName, parts).distinct()


def derived(
    store: Store, tables: dict[str, DataFrame], changed: DataFrame
) -> list[tuple[dict[str, DataFrame], DataFrame]]:
    """Versions to write beside `tables`: the relations, and the sessions they replace."""
    if not set(COUNTS) & set(tables):
        return []
    changed = keep(changed.select("session_id"), "changed")
    before = Tables({n: store.table(n, changed) for n in COUNTS})
    now = Tables({n: tables[n] if n in tables else before[n] for n in COUNTS})
    held = _ids(now).join(
        now["sessions"].select(F.col("id").alias("session_id"), "started_at"), "session_id", "left"
    )
    held = keep(_shaped(held, "id_holders"), "held")
    asked = keep(_ids(before).select("id", "relation").unionByName(held.select("id", "relation")).distinct(), "asked")
    others = store.holders(asked).join(changed, "session_id", "left_anti")
    holders = keep(others.unionByName(held), "holders")
    opened = F.struct(F.col("started_at").isNull(), F.col("started_at"), F.col("session_id").alias("session_id"))
    first = holders.groupBy("relation", "id").agg(
        F.min(opened).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("relation", "id", F.col("first.session_id").alias("owner"))
    copied = holders.join(first, ["relation", "id"]).filter(F.col("session_id") != F.col("owner"))
    concerned = keep(holders.select("session_id").unionByName(changed).distinct(), "concerned")
    # Sessions that are gone from this write hold nothing, and others keep what was not asked about.
    unasked = store.table("copied_ids", concerned).join(changed, "session_id", "left_anti").join(
        asked, ["id", "relation"], "left_anti"
    )
    copied = keep(_shaped(copied, "copied_ids").unionByName(_shaped(unasked, "copied_ids")), "copied")
    rest = concerned.join(changed, "session_id", "left_anti")
    whole: dict[str, DataFrame] = {
        n: now[n].select(*schema.ALL_TABLES[n].names).unionByName(store.table(n, rest)) for n in COUNTS
    }
    t = Tables({**whole, "copied_ids": copied})
    counts = reduce(
        DataFrame.unionByName,
        [_shaped(rollups(t, f).withColumn("family", F.lit(f)), "session_rollups") for f in ("live", "corpus")],
    )
    return [({"id_holders": held}, changed), ({"copied_ids": copied, "session_rollups": counts}, concerned)]
