"""Running values over ordered groups of any size.

A window function alone would put a whole group into one task. Here the rows are range
partitioned by (keys, order) into blocks of even size, so a group that holds a third of
all rows spans many blocks. Every block is summarised, the few summaries are accumulated
per group, and each row combines the running value inside its block with what came
before the block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut

BLOCK = "_block"


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with a block number; blocks follow (keys, order). The order must be total,
    else ties of one group may change places between runs."""
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*cols).withColumn(BLOCK, F.spark_partition_id())
    return cut(ranged)


def running_over(
    blocks: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running values; ``values`` maps a name to (``sum`` or ``max``, column)."""
    folds = {"sum": F.sum, "max": F.max}
    # As one struct, keys that are NULL compare equal and joins keep the partitioning.
    group = ["_key", BLOCK]
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = blocks.withColumns({"_key": key, **{f"_in_{n}": column for n, (_, column) in values.items()}})
    totals = rows.groupBy(*group).agg(*[folds[f](f"_in_{n}").alias(f"_t_{n}") for n, (f, _) in values.items()])
    before = Window.partitionBy("_key").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, *[folds[f](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (f, _) in values.items()]
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{n}": folds[f](f"_in_{n}").over(inside) for n, (f, _) in values.items()})
    matched = local.join(carried, group)
    out = []
    for n, (f, _) in values.items():
        here, past = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        joined = F.greatest(here, past) if f == "max" else here + F.coalesce(past, F.lit(0))
        out.append(joined.alias(n))
    return matched.select(*blocks.columns, *out)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row_no"
) -> DataFrame:
    """Row numbers from 1 within ``keys`` (over the whole frame when there are none)."""
    blocks = ordered_blocks(df, keys, order)
    return running_over(blocks, keys, order, {name: ("sum", F.lit(1).cast("long"))}).drop(BLOCK)


def priority_order(tasks: DataFrame) -> DataFrame:
    """Tasks with their place in the queue: high priority first, first in first out."""
    return numbered(tasks, [], [F.desc("priority"), F.asc("seq")], "place")


def chunk(rows: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """Consecutive chunks of ``size`` rows, numbered from 0."""
    return numbered(rows, [], order, "_n").withColumn("chunk_no", F.floor((F.col("_n") - 1) / size)).drop("_n")


def first_rows(rows: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows; the limit may be larger than one task could hold."""
    return numbered(rows, [], order, "_n").filter(F.col("_n") <= limit).drop("_n")


def dedup_first_by_url(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order; reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
