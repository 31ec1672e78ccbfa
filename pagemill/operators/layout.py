"""Where files go: folder, name, and a free name where two files collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.files import prepare_filename, target_dir
from pagemill.operators.ordered import BLOCK, numbered, ordered_blocks, running_over
from pagemill.session import cut



def dup_suffix(files: DataFrame, order: str = "seq") -> DataFrame:
    """``files(dir, name, order)`` with ``new_name``: the first file of a name keeps it,
    later ones become ``stem_1.ext``, ``stem_2.ext`` ..., skipping names other files have.

    The k-th duplicate takes the k-th free number. Numbers taken by other files are
    counted with a running sum in the same order, so neither a name that many files
    share nor a long row of taken numbers ends up in one task."""
    rows = numbered(files, ["dir", "name"], [order], "_k").withColumns(
        {
            "_stem": F.regexp_extract("name", r"(?s)\A(.+)(\.[^.]+)\z|\A(.*)\z", 1),
            "_ext": F.regexp_extract("name", r"(?s)\A(.+)(\.[^.]+)\z|\A(.*)\z", 2),
        }
    )
    rows = rows.withColumn("_stem", F.when(F.col("_ext") == "", F.col("name")).otherwise(F.col("_stem")))
    # Read four times below.
    rows = cut(rows)
    firsts = rows.filter("_k = 1")
    again = rows.filter("_k > 1").withColumn("_k", F.col("_k") - 1)
    # Names of the form stem_number.ext occupy that number of (stem, ext).
    number = F.regexp_extract("_stem", r"(?s)\A(.+)_([1-9][0-9]{0,17})\z", 2)
    taken = firsts.filter(number != "").select(
        "dir",
        F.regexp_extract("_stem", r"(?s)\A(.+)_([1-9][0-9]{0,17})\z", 1).alias("_stem"),
        "_ext",
        number.cast("long").alias("_number"),
    )
    hit = again.select("dir", "_stem", "_ext").distinct()
    taken = taken.join(hit, ["dir", "_stem", "_ext"], "left_semi")
    family = ["dir", "_stem", "_ext"]
    # The i-th taken number b leaves b - i free ones below it, so it moves every
    # duplicate whose rank is above b - i.
    ranked = numbered(taken, family, ["_number"], "_i")
    steps = ranked.select(
        *family,
        (F.col("_number") - F.col("_i") + 1).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_k"),
        F.lit(None).cast("string").alias("_id"),
    )
    ids = again.withColumn("_id", F.col(order).cast("string"))
    asks = ids.select(*family, F.col("_k").alias("_at"), F.lit(1).alias("_kind"), "_k", "_id")
    line = ["_at", "_kind", "_id"]
    blocks = ordered_blocks(steps.unionByName(asks), family, line)
    passed = F.when(F.col("_kind") == 0, 1).otherwise(0).cast("long")
    counted = running_over(blocks, family, line, {"_skip": ("sum", passed)}).filter("_kind = 1").drop(BLOCK)
    moved = counted.select(*family, "_id", (F.col("_k") + F.col("_skip")).alias("_number"))
    named = ids.join(moved, [*family, "_id"]).withColumn(
        "new_name", F.concat("_stem", F.lit("_"), F.col("_number").cast("string"), "_ext")
    )
    kept = firsts.withColumn("new_name", F.col("name"))
    out = [*files.columns, "new_name"]
    return kept.select(*out).unionByName(named.select(*out))


def organize_batch(files: DataFrame, base: str, order: str = "seq", **options) -> DataFrame:
    """``files(name, type, course, order)`` with ``dir`` and ``new_name``; a missing type is
    ``other``, a missing course ``Unknown``."""
    course = F.coalesce("course", F.lit("Unknown"))
    placed = files.withColumns(
        {
            "dir": target_dir(F.lit(base), F.coalesce("type", F.lit("other")), course, **options),
            "original_name": F.col("name"),
            "name": prepare_filename(F.col("name"), course),
        }
    )
    return dup_suffix(placed, order)
