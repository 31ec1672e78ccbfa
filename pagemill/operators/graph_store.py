"""Tables of a link graph that are stored by key.

A stored table has one file per bucket of its key and write, in a folder of the bucket's number. Joins on the key read
it without a shuffle, and who knows in which buckets the keys of the other side lie reads these only. Folders are
named by the catalog, so that finding out which buckets a write touched runs no job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_path

PART = "part"


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as shuffles have partitions, so that a shuffled side comes as the stored one lies."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Stored:
    """A growing table, bucketed by ``keys``; ``by`` are further folders above the bucket's one."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], by: Sequence[str] = ()):
        self.spark, self.keys, self.by = spark, list(keys), list(by)
        self.buckets = bucket_count(spark)
        self.name = f"pagemill_{uuid.uuid4().hex}"
        self.path = shared_path(spark, "stored")
        self.schema = None

    def append(self, rows: DataFrame) -> None:
        """Write rows; those of a bucket come from one task where they are dealt by the keys already."""
        placed = rows.withColumn(PART, F.pmod(F.hash(*self.keys), F.lit(self.buckets)))
        self.schema = placed.schema
        writer = placed.write.mode("append").format("parquet").option("path", self.path)
        writer = writer.partitionBy(*self.by, PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.saveAsTable(self.name)

    def folders(self, **values) -> list[int]:
        """The buckets that rows with these values of ``by`` were written to: at most as many as there are."""
        if self.schema is None:
            return []
        want = {f"{k}={v}" for k, v in values.items()}
        found = set()
        for (spec,) in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            parts = spec.split("/")
            if want <= set(parts):
                found.add(int(parts[-1].split("=")[1]))
        return sorted(found)

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The table, or the buckets with these numbers."""
        rows = self.spark.table(self.name)
        if parts is not None and len(parts) < self.buckets:
            rows = rows.filter(F.col(PART).isin(list(parts)))
        return rows

    def drop(self) -> None:
        """Forget the table; its files stay until the shared folder is cleared."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def files(self) -> DataFrame:
        """The rows, read from the files, which needs no catalog."""
        return self.spark.read.schema(self.schema).parquet(self.path).drop(PART)
