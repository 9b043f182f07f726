"""Continuous import: new export files are loaded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklore import fixed_values as fx
from tracklore.plans.import_history import load_documents
from tracklore.session import configure
from tracklore.sources.history_json import file_name, own_files, parent_path, qualified
from tracklore.sources.warehouse import Warehouse


def stream_history(
    spark: SparkSession,
    path: str,
    root: str,
    checkpoint: str,
    pattern: str = fx.EXPORT_FILE_PATTERN,
    **trigger,
) -> StreamingQuery:
    """Load each file of ``path`` once, the same files as a batch import: the folder's own
    ones, none of its sub-folders. ``checkpoint`` is the folder that remembers which were
    loaded. Replayed batches are harmless: loading inserts only what is not stored, and the
    stored profile and a view published in this session follow each batch. Default trigger:
    everything available, then stop."""
    configure(spark)
    warehouse = Warehouse(spark, root)
    is_own = parent_path() == F.lit(qualified(spark, path))
    documents = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", True)
        .load(own_files(path, pattern))
        # The pattern may also stand for a sub-folder, whose files Spark then lists.
        .filter(is_own)
        .select(file_name(), "value")
    )

    def load(batch: DataFrame, _: int) -> None:
        load_documents(warehouse, batch)
        warehouse.refresh_profile()

    return (
        documents.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
