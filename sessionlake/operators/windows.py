"""Ordered folds over a thread that never put a whole thread in one task.

A thread may hold a large share of all rows, so nothing here partitions a window by the thread
alone. A thread is cut into slices; each slice folds on its own, one summary row per slice is
folded across the thread, and what the earlier slices ended on is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THREAD = ["session_id", "source"]
SLICE_ROWS = 65_536


def block_of(position: Column, rows: int = SLICE_ROWS) -> Column:
    """The slice a dense position falls in."""
    return F.floor(position / F.lit(rows)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    counts: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Adds, per row, how many earlier rows meet a condition, their sum, the latest and the largest.

    `counts` and `sums` look strictly before the row. `lasts` and `maxes` include the row unless `strict`.
    Slices must follow the order: every row of one slice comes before every row of the next.
    """
    lasts, maxes = dict(lasts or {}), dict(maxes or {})
    added = {n: c.cast("long") for n, c in {**(counts or {}), **(sums or {})}.items()}
    kinds = {**{n: "int" for n in counts or {}}, **{n: "long" for n in sums or {}}}
    sliced = df.withColumn("_slice", slice_by)
    spread = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = spread.rowsBetween(Window.unboundedPreceding, -1)
    upto = before if strict else spread.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = sliced.select(
        "*",
        *[
            F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_in_{n}")
            for n, c in added.items()
        ],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_in_{n}") for n, c in lasts.items()],
        *[F.max(c).over(upto).alias(f"_in_{n}") for n, c in maxes.items()],
    )

    position = F.struct(*order)
    ends = sliced.groupBy(*keys, "_slice").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in added.items()],
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(n) for n, c in lasts.items()],
        *[F.max(c).alias(n) for n, c in maxes.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.select(
            *keys,
            "_slice",
            F.lag(F.lit(True)).over(across).alias("_later"),
            *[F.sum(n).over(earlier).alias(f"_from_{n}") for n in added],
            *[F.last(n, ignorenulls=True).over(earlier).alias(f"_from_{n}") for n in lasts],
            *[F.max(n).over(earlier).alias(f"_from_{n}") for n in maxes],
        )
        .filter(F.col("_later"))
        .drop("_later")
    )
    joined = local.join(carried, [*keys, "_slice"], "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_in_{n}") + F.coalesce(F.col(f"_from_{n}"), F.lit(0))).cast(kind).alias(n)
            for n, kind in kinds.items()
        ],
        *[F.coalesce(f"_in_{n}", f"_from_{n}").alias(n) for n in lasts],
        *[F.greatest(f"_in_{n}", f"_from_{n}").alias(n) for n in maxes],
    )


#: Sizes of blocks that cover an interval: 2^0 to 2^27.
LEVELS = 28


def covering(first: Column, last: Column) -> Column:
    """The blocks (level, block) that make up the whole numbers from `first` to `last`: of each size two
    at most, none in another. A block of a level holds 2^level numbers."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        odd_low, odd_high = F.pmod(low, F.lit(2)) == 1, F.pmod(high, F.lit(2)) == 1
        block = lambda b: F.struct(level.alias("level"), b.alias("block"))
        return F.array(
            F.when((low < high) & odd_low, block(low)),
            F.when((low + odd_low.cast("long") < high) & odd_high, block(high - 1)),
        )

    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return F.array_compact(F.flatten(F.transform(levels, at)))


def blocks_holding(number: Column) -> Column:
    """The block of each size that a whole number is in."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return F.transform(
        levels,
        lambda level: F.struct(
            level.alias("level"),
            F.floor(number / F.call_function("shiftleft", F.lit(1).cast("long"), level)).cast("long").alias("block"),
        ),
    )


def previous(
    df: DataFrame, position: str, values: Mapping[str, Column], keys: Sequence[str] = THREAD
) -> DataFrame:
    """`lag` over a thread: the given values of the row just before this one, NULL on the first."""
    held = F.struct(*[c.alias(n) for n, c in values.items()])
    folded = running(
        df, keys, block_of(F.col(position)), [position], lasts={"_previous": held}, strict=True
    )
    return folded.select(*df.columns, *[F.col(f"_previous.{n}").alias(n) for n in values])


def distinct_ranks(
    values: DataFrame, group: Sequence[str], value: str, splits: int = 256
) -> DataFrame:
    """Exact ranks of a numeric column within each group, without sorting a group in one task.

    Takes the column with duplicates, answers one row per distinct value: `n` rows hold it and
    `below` rows lie under it, of `total` in the group. Values are spread over ranges whose
    bounds come from a sketch; the ranges' counts are exact, so the ranks are.
    """
    weighted = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    marks = [i / splits for i in range(1, splits)]
    bounds = weighted.groupBy(*group).agg(
        F.percentile_approx(value, F.array(*map(F.lit, marks)), F.lit(4 * splits)).alias("_bounds"),
        F.sum("n").alias("total"),
    )
    ranged = weighted.join(F.broadcast(bounds), list(group)).withColumn(
        "_range", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))
    )
    starts = (
        ranged.groupBy(*group, "_range")
        .agg(F.sum("n").alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*group)
                    .orderBy("_range")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_range").orderBy(value)
    return (
        ranged.join(F.broadcast(starts), [*group, "_range"])
        .withColumn(
            "below",
            F.col("_start")
            + F.coalesce(
                F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select(*group, value, "n", "below", "total")
    )
