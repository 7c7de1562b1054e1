"""A versioned sink for streams of aggregates: each batch makes a new version of a small table, and a replayed batch makes the same one again.

Version b is what version b - 1 and batch b add up to. A batch that is run again after a failure reads the same older version and overwrites its own, so
nothing is counted twice; a version counts once its ``_SUCCESS`` is written. The two newest versions are kept. Aggregates are partial before they are
shuffled, the table grows with its keys only, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platewise.session import work_path


class VersionedTable:
    """Versions of one table below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        path, files = self._files()
        if not files.exists(path):
            return []
        made = [s.getPath() for s in files.listStatus(path)]
        whole = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in made if p.getName().isdigit() and files.exists(whole(p, "_SUCCESS")))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}")

    def latest(self) -> DataFrame | None:
        found = self.versions()
        return self.read(found[-1]) if found else None

    def add(self, batch: DataFrame, version: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Write ``version``: the newest older version and ``batch``, put together by ``merge``."""
        older = [v for v in self.versions() if v < version]
        rows = self.read(older[-1]).unionByName(batch) if older else batch
        merge(rows).write.mode("overwrite").parquet(f"{self.path}/{version}")
        path, files = self._files()
        for old in older[:-1]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, str(old)), True)


def run_merged(stream: DataFrame, table: VersionedTable, count: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], checkpoint: str | None = None) -> DataFrame | None:
    """Count each batch, merge it into the table, and return what is there when all input is read; None if there was none."""

    def each(batch: DataFrame, version: int) -> None:
        table.add(count(batch), version, merge)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or work_path(table.spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.latest()
