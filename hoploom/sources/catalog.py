"""A folder of Parquet tables that holds an index and grows by appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators.keys import missing


class IndexCatalog:
    """Named Parquet tables under one path of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table; an empty one of ``schema`` if there is none."""
        if schema is not None and not self.exists(name):
            return self.spark.createDataFrame([], schema)
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self._at(name))
        except AnalysisException as e:
            raise FileNotFoundError(self._at(name)) from e

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a table; ``df`` must not read it."""
        df.write.mode("overwrite").parquet(self._at(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table; one job, so that all of them or none are seen."""
        df.write.mode("append").parquet(self._at(name))

    def write_partitions(self, name: str, df: DataFrame, by: str, within: str) -> None:
        """Replaces those folders of a table partitioned ``by`` a column that ``df`` has rows of; ``df`` must not read them.

        Rows are dealt by ranges of ``by`` and ``within``: few files a folder, and a large folder is written by several tasks.
        """
        df.repartitionByRange(by, within).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self._at(name))

    def append_missing(self, name: str, df: DataFrame, key: str, schema: str) -> DataFrame:
        """Appends rows whose key is not stored yet and gives them back as stored."""
        new = missing(df, self.read(name, schema), key).persist()
        try:
            if not new.isEmpty():
                new.write.mode("append").parquet(self._at(name))
        finally:
            new.unpersist()
        return self.read(name, schema)
