"""Tables of one operator's run in the shared folder, deleted as soon as nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrilake.session import release_driver, remove_path, shared_path


class Scratch:
    """``cut`` writes a table, ``drop`` deletes it, leaving the ``with`` block deletes the rest and
    gives back what the driver took for the run.

    A written table is complete, so an executor lost later costs nothing of what it was made
    from. Only drop what no table that is still to be written depends on."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = shared_path(spark, "scratch")
        self._written = 0
        self._tables: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self._written}"
        self._written += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        for known, path in self._tables:
            if known is table:
                remove_path(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove_path(self.spark, self.folder)
        release_driver(self.spark)
