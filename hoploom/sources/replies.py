"""A store of a language model's replies: no prompt is sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .catalog import IndexCatalog
from .models import LlmClient, ask

REPLIES = "key string, model string, reply string"


class ReplyStore:
    """Replies under one path, by the digest of model, system text and prompt.

    Prompts that are not stored are asked once each, in slices of about ``slice_rows``
    that are written as they are done: a run that fails goes on from the last slice.
    Replies of failed calls are not stored, so a later run asks again. ``rate`` bounds the
    calls that a task starts in a second.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, slice_rows: int = 10_000, threads: int = 16, rate: float | None = None):
        self.catalog, self.model = IndexCatalog(spark, path), model
        self.slice_rows, self.threads, self.rate = slice_rows, threads, rate

    def _key(self, prompt: str, system: str):
        parts = [F.lit(self.model), F.lit(system), F.coalesce(F.col(prompt), F.lit(""))]
        # Lengths keep texts apart that only meet when they are joined.
        return F.sha2(F.concat(*[x for part in parts for x in (F.length(part).cast("string"), F.lit(":"), part)]), 256)

    def ask(self, df: DataFrame, client: LlmClient, prompt_col: str, out: str = "reply", system: str = "", on_error: str | None = None) -> DataFrame:
        """As ``models.ask``, from the store where it can."""
        name = "_prompt_key"
        keyed = cut_lineage(df.drop(out).withColumn(name, self._key(prompt_col, system)))
        prompts = keyed.select(F.col(name).alias("key"), F.coalesce(F.col(prompt_col), F.lit("")).alias("prompt")).dropDuplicates(["key"])
        todo = cut_lineage(prompts.join(self.catalog.read("replies", REPLIES).select("key"), "key", "left_anti"))
        slices = -(-todo.count() // self.slice_rows)
        for k in range(slices):
            part = todo.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k)
            replies = ask(part, client, "prompt", "reply", system, threads=self.threads, rate=self.rate, null_on_error=True)
            replies.where("reply IS NOT NULL").select("key", F.lit(self.model).alias("model"), "reply").write.mode("append").parquet(f"{self.catalog.path}/replies")
        # A slice that was written twice gives one reply a key.
        stored = self.catalog.read("replies", REPLIES).groupBy(F.col("key").alias(name)).agg(F.min("reply").alias(out))
        found = keyed.join(stored, name, "left").drop(name)
        if on_error is None:
            failed = found.where(F.col(out).isNull()).count()
            if failed:
                raise RuntimeError(f"{failed} prompts have no reply; what succeeded is stored")
            return found
        other = F.col(on_error[1:-1]).cast("string") if on_error.startswith("{") else F.lit(on_error)
        return found.withColumn(out, F.coalesce(F.col(out), other))
