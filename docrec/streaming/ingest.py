"""Structured Streaming with keyed state: pages that arrive in any order, and the log of corrections.

Pages wait in the state store under their document, latest writes under their field, so a batch reads and writes the keys that
it touches; each batch's output is a folder of its own, which a batch that runs again replaces. Contents that were seen are
a table in buckets, of which a batch reads those of its contents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docrec.operators.corrections import FIELD, latest

GIVEN = "doc_id long, page_no int, text string, complete boolean"
DONE = "ident string, doc_id long, batch long, bucket string"


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def keyed_state(spark: SparkSession) -> None:
    """State by key on disk, of which a checkpoint writes the changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def gathered(pages: DataFrame, patience: int) -> DataFrame:
    """``doc_id, page_no, page_count, text`` as they come -> the pages of each document once all are there (``complete``), or as they are after ``patience`` milliseconds (0: never). Later pages of a document that is over are passed by."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, of, over = state.get if state.exists else ("{}", 0, False)
        own = json.loads(held)
        if not over and not state.hasTimedOut:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    of = max(of, int(r.page_count))
                    own.setdefault(str(r.page_no), None if pd.isna(r.text) else r.text)
        ends = not over and (state.hasTimedOut or len(own) >= of)
        if ends:
            order = sorted(own, key=int)
            yield pd.DataFrame({"doc_id": [key[0]] * len(order), "page_no": [int(n) for n in order], "text": [own[n] for n in order], "complete": [not state.hasTimedOut] * len(order)})
            own, over = {}, True
        state.update((json.dumps(own), of, over))
        if patience and not over:
            state.setTimeoutDuration(patience)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return pages.groupBy("doc_id").applyInPandasWithState(step, GIVEN, "pages string, of int, over boolean", "append", timeout)


def incremental_ingest(
    spark: SparkSession, pages_dir: str, schema: str, extract: Callable[[DataFrame], DataFrame], out_dir: str, state_dir: str, files_per_batch: int = 5, patience: int = 0, incomplete: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Extract records from page files (``doc_id, page_no, page_count, text``) as they arrive, each document content once.

    * a document is extracted when its ``page_count`` pages are there; a page that comes twice counts as it came first
    * of equal contents the document that is complete first counts, in one batch the one with the smallest id
    * a document that is not complete within ``patience`` milliseconds of its last page is handed to ``incomplete`` and no longer waited for; such a stream goes on until it is stopped.
      Without patience (0) pages wait for ever, and the stream ends when all files are read
    * a batch that runs again gives the same output: contents seen before are those of earlier batches
    """
    keyed_state(spark)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))["text"], "\f")

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if incomplete:
            incomplete(batch.where("NOT complete"), number)
        whole = batch.where("complete").groupBy("doc_id").agg(F.md5(text.cast("binary")).alias("ident")).withColumn("bucket", F.substring("ident", 1, 2)).persist()
        buckets = [r[0] for r in whole.select("bucket").distinct().collect()]  # 256 at most
        done = _existing(spark, f"{state_dir}/done", DONE).where(F.col("bucket").isin(buckets) & (F.col("batch") < number))
        fresh = whole.join(done.select("ident"), "ident", "left_anti").groupBy("ident", "bucket").agg(F.min("doc_id").alias("doc_id")).persist()
        extract(batch.join(fresh.select("doc_id"), "doc_id", "left_semi").drop("complete")).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        fresh.select("ident", "doc_id", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/done/batch={number}")
        for df in (fresh, whole, batch):
            df.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages_dir)
    trigger = {"processingTime": "1 second"} if patience else {"availableNow": True}
    return gathered(stream, patience).writeStream.foreachBatch(step).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(**trigger).start()


def corrections_stream(spark: SparkSession, log_dir: str, schema: str, state_dir: str, files_per_batch: int = 5) -> StreamingQuery:
    """Keep the latest write of each field as the log arrives: an aggregation with state by field, of which each batch writes the fields that it changed. Clears are kept, so that a late older write does not come back."""
    keyed_state(spark)

    def step(batch: DataFrame, number: int) -> None:
        batch.select(*FIELD, "l.*").write.mode("overwrite").parquet(f"{state_dir}/state/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
    columns = [c for c in stream.columns if c not in FIELD]
    last = stream.groupBy(*FIELD).agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("l"))
    return last.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()


def current_state(spark: SparkSession, state_dir: str, number: int, schema: str) -> DataFrame:
    """The state after batch ``number``: of each field the last write that any batch up to it gave out."""
    changes = _existing(spark, f"{state_dir}/state", f"{schema}, batch long").where(F.col("batch") <= number).drop("batch")
    return latest(changes)
