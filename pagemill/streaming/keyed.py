"""Tables that a stream writes by key, one batch after the other.

Every batch is written under its number, and a manifest row that names it is written last. A batch that is run again
after a lost driver replaces what it wrote before, so readers see each batch whole and once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, batch bigint, version string"


class KeyedTable:
    """A table in the folder ``path`` to which batches of keyed rows are committed.

    ``run`` names the stream (its checkpoint): batch numbers count within it. Files lie in folders by a hash of the
    keys, so looking keys up reads the folders of these keys only."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> DataFrame | None:
        rows = self._read(f"{self.path}/manifest", MANIFEST)
        if rows is None:
            return None
        return rows.groupBy("run", "batch").agg(F.max("version").alias("version"))

    def _read(self, path: str, schema: str) -> DataFrame | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(path) if system.exists(hadoop) else None

    def committed(self, run: str, batch: int) -> bool:
        """Whether a batch is in the table."""
        manifest = self._manifest()
        return manifest is not None and not manifest.filter((F.col("run") == run) & (F.col("batch") == batch)).isEmpty()

    def commit(self, rows: DataFrame, run: str, batch: int, **more: DataFrame) -> None:
        """Add a batch, and with it the frames ``more``, which ``attached`` gives back by their names. What an earlier
        try of the same batch added counts no more: versions rise with the tries that the manifest has."""
        manifest = self._read(f"{self.path}/manifest", MANIFEST)
        tries = 0 if manifest is None else manifest.filter((F.col("run") == run) & (F.col("batch") == batch)).count()
        version = f"{tries:010d}-{uuid.uuid4().hex}"
        rows.withColumn("ktpart", self._place()).write.partitionBy("ktpart").parquet(f"{self.path}/rows/ktversion={version}")
        for name, frame in more.items():
            frame.write.parquet(f"{self.path}/more-{name}/ktversion={version}")
        named = self.spark.createDataFrame([(run, batch, version)], MANIFEST).coalesce(1)
        named.write.mode("append").parquet(f"{self.path}/manifest")

    def attached(self, name: str, schema: str) -> DataFrame:
        """The rows of a frame that was committed with the batches."""
        manifest, rows = self._manifest(), self._read(f"{self.path}/more-{name}", f"{schema}, ktversion string")
        if manifest is None or rows is None:
            return self.spark.createDataFrame([], schema)
        return rows.join(manifest.select(F.col("version").alias("ktversion")), "ktversion", "left_semi").drop("ktversion")

    def batches(self, schema: str, parts: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of all batches with ``_run`` and ``_batch``; of the folders ``parts`` if they are given."""
        manifest = self._manifest()
        if manifest is None:
            return None
        rows = self._read(f"{self.path}/rows", f"{schema}, ktversion string, ktpart int")
        if rows is None:
            return None
        rows = rows if parts is None else rows.filter(F.col("ktpart").isin(list(parts)))
        named = manifest.select(F.col("version").alias("ktversion"), F.col("run").alias("_run"), F.col("batch").alias("_batch"))
        return rows.join(named, "ktversion").drop("ktversion", "ktpart")

    def new(self, rows: DataFrame, schema: str) -> DataFrame:
        """Rows whose keys are in no batch: an anti join with the folders that these keys lie in. The driver learns
        which these are, ``buckets`` numbers at most."""
        parts = [r[0] for r in rows.select(self._place()).distinct().collect()]
        known = self.batches(schema, parts)
        return rows if known is None else rows.join(known.select(*self.keys).distinct(), self.keys, "left_anti")

    def latest(self, schema: str) -> DataFrame:
        """The last committed row of each key: that of the batch with the largest number. A table of changing rows
        belongs to one stream, whose checkpoint counts on after a restart."""
        rows = self.batches(schema)
        names = [c.split()[0] for c in schema.split(", ")]
        if rows is None:
            return self.spark.createDataFrame([], schema)
        rest = [c for c in names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
        return best.select(*self.keys, "_r.*").select(*names)
