"""Incremental analysis: a stream of changed files, analysed batch by batch with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import facts, findings, rules
from ..sources import files
from ..sources.config import Config


def findings_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, config: Config | None = None, available_now: bool = True):
    """Read (path, text) Parquet files as they arrive and append their file findings to ``sink``.

    Facts and file rules hold for a file alone, so each batch is independent and the sink's checkpoint makes it exactly once;
    directory and repository rules group the whole and run over the facts kept, not here.
    """
    config = config or Config()
    raw = spark.readStream.schema("path string, text string").parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        found = files.discovered(df, config.ignores)
        full = facts.extended(found.where("language_id = 'php'"))
        made = rules.fact_findings(full, {r: {} for r in rules.FACT_RULES})
        made.orderBy(*findings.raw_order()).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
