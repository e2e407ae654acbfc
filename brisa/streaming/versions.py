"""Versioned tables of a stream: one folder for each epoch, written whole, so a retried epoch writes the same again.

A reader at epoch K sees the versions before K, whatever a failed attempt at K has left.
Folders count as written when Spark's ``_SUCCESS`` mark is there.  Paths are listed and
removed through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.session import remove_path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def list_versions(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``<prefix><number>`` under ``path``, ascending."""
    fs, at, make = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = [re.fullmatch(re.escape(prefix) + r"(\d+)", s.getPath().getName()) for s in fs.listStatus(at)]
    numbers = sorted((int(m[1]), m[0]) for m in found if m)
    return [n for n, name in numbers if fs.exists(make(f"{path}/{name}/_SUCCESS"))]


@dataclass(frozen=True)
class Versions:
    """A table whose whole content is written anew for each epoch."""
    path: str
    schema: str | object

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{int(epoch)}")

    def before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The newest version below ``epoch``; empty if there is none."""
        known = [v for v in list_versions(spark, self.path, "v") if v < epoch]
        return self._read(spark, known[-1:])

    def newest(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, list_versions(spark, self.path, "v")[-1:])

    def _read(self, spark: SparkSession, versions: list[int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/v{v}" for v in versions])

    def forget(self, spark: SparkSession, epoch: int) -> None:
        """Remove versions that a retry of ``epoch`` can't need: all but the newest one below it."""
        for v in [v for v in list_versions(spark, self.path, "v") if v < epoch][:-1]:
            remove_path(spark, f"{self.path}/v{v}")


@dataclass(frozen=True)
class Folding:
    """A table kept as changes by epoch, which are folded into a base from time to time.

    Every ``fold_every`` epochs what came before is written as one base, so a reader opens one base and
    ``2 * fold_every`` changes at most, however long the stream runs.  A base of epoch K holds the epochs
    below K, which are committed by then; a retried epoch writes its own folder again and nothing else.
    """
    path: str
    schema: object
    fold_every: int = 20

    def _combined(self, rows: DataFrame) -> DataFrame:
        """One row per key from all of ``rows``, of which a higher ``_age`` is newer."""
        raise NotImplementedError

    def write(self, df: DataFrame, epoch: int) -> None:
        """What ``epoch`` changes."""
        df.write.mode("overwrite").parquet(f"{self.path}/epoch={int(epoch)}")

    def before(self, spark: SparkSession, epoch: int | None = None) -> DataFrame:
        """The table as of the epochs below ``epoch`` (None: all that is written)."""
        bases = [b for b in list_versions(spark, self.path, "base=") if epoch is None or b <= epoch]
        base = bases[-1] if bases else 0
        changes = [e for e in list_versions(spark, self.path, "epoch=") if base <= e and (epoch is None or e < epoch)]
        parts = [(0, [f"{self.path}/base={base}"])] if bases else []
        parts += [(e + 1, [f"{self.path}/epoch={e}"]) for e in changes]
        out = None
        for age, paths in parts:
            part = spark.read.schema(self.schema).parquet(*paths).withColumn("_age", F.lit(age))
            out = part if out is None else out.unionByName(part)
        return spark.createDataFrame([], self.schema) if out is None else self._combined(out)

    def fold(self, spark: SparkSession, epoch: int) -> None:
        """Before ``epoch`` is written: fold if it is time, and remove what an older base made superfluous."""
        if epoch == 0 or epoch % self.fold_every:
            return
        self.before(spark, epoch).write.mode("overwrite").parquet(f"{self.path}/base={int(epoch)}")
        older = [b for b in list_versions(spark, self.path, "base=") if b < epoch]
        if older:  # a reader that has listed the older base still finds what it needs
            for e in [e for e in list_versions(spark, self.path, "epoch=") if e < older[-1]]:
                remove_path(spark, f"{self.path}/epoch={e}")
            for b in older[:-1]:
                remove_path(spark, f"{self.path}/base={b}")


@dataclass(frozen=True)
class Keyed(Folding):
    """The newest row of every ``key`` (one column) holds."""
    key: str = "key"

    def _combined(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "_age")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_age").alias("_r")).select(self.key, "_r.*")


@dataclass(frozen=True)
class Summed(Folding):
    """The numbers ``sums`` of every key add up; the other columns are the key."""
    sums: tuple[str, ...] = ()

    def _combined(self, rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c not in (*self.sums, "_age")]
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in self.sums))
