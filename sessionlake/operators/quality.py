"""Checks on what is stored: content no project holds, broken promises, leaked credentials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import schema
from sessionlake.functions.text import holds_secret
from sessionlake.operators.relations import Tables


def unplaceable_content(t: Tables) -> DataFrame:
    """Sessions without a project that hold work all the same, counted per relation."""
    lost = t["sessions"].filter(F.col("project_dir").isNull()).select(
        F.col("id").alias("session_id")
    )
    names = ("turns", "api_calls", "tool_calls", "agent_runs", "compactions")
    rows = lost
    for name in names:
        held = t[name].groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(held, "session_id", "left")
    counted = rows.select("session_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return counted.filter(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names]))


def duplicate_keys(t: Tables) -> DataFrame:
    """Keys a relation holds more than once."""

    def twice(name: str, keys: list[str]) -> DataFrame:
        return (
            t[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            .select(F.lit(name).alias("relation"), F.concat_ws(" ", *keys).alias("key"), "n")
        )

    names = [n for n in schema.KEYS if n in t.frames]
    return reduce(DataFrame.unionByName, [twice(n, schema.KEYS[n]) for n in names])


def gaps_in_index(t: Tables) -> DataFrame:
    """Threads whose positions are not the numbers from 0 on."""

    def uneven(name: str) -> DataFrame:
        return (
            t[name].groupBy("session_id", "source")
            .agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("top"),
                 F.min("index").alias("low"))
            .filter((F.col("top") + 1 != F.col("n")) | (F.col("low") != 0))
            .select(F.lit(name).alias("relation"), "session_id", "source", "n", "low", "top")
        )

    return uneven("turns").unionByName(uneven("api_calls")).unionByName(uneven("tool_calls"))


def foreign_words(t: Tables) -> DataFrame:
    """Stored words outside the vocabularies rows may use."""

    def odd(name: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
        return (
            t[name].filter(~F.col(column).isin(*allowed))
            .groupBy(F.col(column).alias("word")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("relation"), F.lit(column).alias("column"), "word", "n")
        )

    parts = [odd("interjections", "sender", schema.SENDERS)]
    for name in schema.ENRICHMENTS:
        parts.append(odd(name, "category", schema.CATEGORIES))
        parts.append(odd(name, "outcome", schema.OUTCOMES))
    return reduce(DataFrame.unionByName, parts)


# The stored text a credential could sit in.
TEXTS = (
    ("turns", "prompt"), ("api_calls", "text"), ("api_calls", "thinking"),
    ("tool_calls", "input"), ("tool_calls", "result"), ("interjections", "text"),
)


def secrets(t: Tables) -> DataFrame:
    """Rows whose text holds the shape of a credential, without the text."""

    def found(name: str, column: str) -> DataFrame:
        return t.live(name).filter(holds_secret(F.col(column))).select(
            F.lit(name).alias("relation"), F.lit(column).alias("column"), "session_id", "source",
            "id",
        )

    return reduce(DataFrame.unionByName, [found(*pair) for pair in TEXTS])


def secret_texts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return rows.filter(holds_secret(text)).select(key)


def shape_differences(df: DataFrame, table: str) -> list[str]:
    """How a frame's columns differ from a relation's declared ones; empty means they agree."""
    declared = {f.name: f.dataType for f in schema.ALL_TABLES[table].fields}
    held = {f.name: f.dataType for f in df.schema.fields}
    missing = [f"missing {n}" for n in declared if n not in held]
    extra = [f"undeclared {n}" for n in held if n not in declared]
    typed = [
        f"{n} is {held[n].simpleString()}, not {declared[n].simpleString()}"
        for n in declared if n in held and held[n] != declared[n]
    ]
    return missing + extra + typed
