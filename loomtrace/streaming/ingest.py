"""Scripts that arrive over time: a file stream of task exports feeds the same analysis batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtrace.operators.publish import task_documents
from loomtrace.operators.trace import end_to_end
from loomtrace.plans.facts import analyze

FLAT = "task_name string, sql string"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: dict[str, list[str]] | None = None, extra: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Analyze every JSON-lines task that lands in ``folder`` once; results are appended below ``out`` by batch number, so a batch that runs again replaces itself.

    Parsing happens on the driver, so a batch holds as many scripts as ``maxFilesPerTrigger`` files do.
    """

    def batch(df: DataFrame, number: int) -> None:
        scripts = [(r.task_name, r.sql) for r in df.filter("sql is not null").select(F.coalesce("task_name", F.lit("unnamed")).alias("task_name"), "sql").toLocalIterator()]
        if scripts:
            facts = analyze(spark, scripts, schema)
            end_to_end(facts).write.mode("overwrite").parquet(f"{out}/end_to_end/batch={number}")
            task_documents(facts).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        if extra:
            extra(df, number)

    stream = spark.readStream.schema(FLAT).option("maxFilesPerTrigger", 100).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
