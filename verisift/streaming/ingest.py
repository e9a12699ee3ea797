"""Staged texts as they arrive: each micro-batch is decided, segmented and written to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.verify import provenance_gap
from ..sources.store import import_decisions, replace_articles

STAGED = "key string, type string, number string, year string, title string, hint string, text string, url string, gazette_issue string, gazette_date string"


def follow(spark: SparkSession, staged: str, articles: str, decisions: str, checkpoint: str, once: bool = True):
    """Starts a query that imports JSON records below staged as they appear.

    A batch replaces the articles of its own instruments only, and its decisions go to a folder of the batch's
    number, so that a batch that runs again after a failure overwrites what it wrote before.
    """

    def load(batch: DataFrame, number: int) -> None:
        rows, found = import_decisions(batch.dropDuplicates(["key"]), provenance_gap("url", "gazette_issue", "gazette_date"))
        replace_articles(found, articles)
        rows.select("key", "id", "status", "verified", "title_match", "n_articles").write.mode("overwrite").parquet(f"{decisions}/batch={number}")

    stream = spark.readStream.schema(STAGED).json(staged)
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
