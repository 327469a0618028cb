import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docrec.streaming import ingest

PAGES = "doc_id long, page_no int, page_count int, text string"
LOG = "doc_id long, page_no int, field_key string, value string, ts long, seq long, op string"


def test_documents_are_extracted_once_when_complete(spark, tmp_path):
    pages, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    extract = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"))

    def arrive(rows):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(pages)
        ingest.incremental_ingest(spark, pages, PAGES, extract, out, state).awaitTermination()
        return {(r["doc_id"], r["n"]) for r in spark.read.parquet(out).collect()}

    assert arrive([(1, 1, 2, "a"), (2, 1, 1, "b")]) == {(2, 1)}
    assert arrive([(1, 2, 2, "c"), (3, 1, 1, "b")]) == {(2, 1), (1, 2)}  # 3 has the content of 2
    assert arrive([(4, 1, 1, "d")]) == {(2, 1), (1, 2), (4, 1)}


def test_last_write_wins_over_batches(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def arrive(rows, number):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)
        ingest.corrections_stream(spark, log, LOG, state).awaitTermination()
        return {(r["field_key"], r["value"]) for r in ingest.current_state(spark, state, number, LOG).collect()}

    assert arrive([(1, 1, "a", "x", 5, 1, "set"), (1, 1, "b", "y", 5, 2, "set")], 0) == {("a", "x"), ("b", "y")}
    assert arrive([(1, 1, "a", None, 9, 3, "clear"), (1, 1, "b", "old", 1, 4, "set")], 1) == {("b", "y")}
    assert arrive([(1, 1, "a", "late", 7, 5, "set")], 2) == {("b", "y")}


def test_documents_that_never_complete_are_handed_over(spark, tmp_path):
    pages, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    given = []
    extract = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"))

    late = lambda df, number: given.extend((r["doc_id"], r["page_no"], r["text"]) for r in df.collect())

    def arrive(rows, until):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(pages)
        ends = time.time() + 30
        while not until() and time.time() < ends:
            time.sleep(0.2)
        assert until()

    def found():
        try:
            return {r["doc_id"] for r in spark.read.parquet(out).collect()}
        except AnalysisException:
            return set()

    spark.createDataFrame([(1, 1, 3, "a"), (1, 1, 3, "again"), (2, 2, 2, None), (2, 1, 2, "b")], PAGES).coalesce(1).write.parquet(pages)
    query = ingest.incremental_ingest(spark, pages, PAGES, extract, out, state, patience=1500, incomplete=late)
    try:
        arrive([(5, 1, 1, "x")], lambda: {2, 5} <= found() and given)
        arrive([(1, 2, 3, "late"), (1, 3, 3, "late"), (7, 1, 1, "z")], lambda: 7 in found())
    finally:
        query.stop()
    assert given == [(1, 1, "a")] and found() == {2, 5, 7}


def test_the_work_of_a_batch_follows_the_batch(spark, tmp_path):
    log, state, pages = (str(tmp_path / n) for n in ("log", "state", "pages"))
    batches = 24
    rows = [(k, 1, f"f{j}", str(k), k, k * 10 + j, "set") for k in range(batches) for j in range(5)]
    spark.createDataFrame(rows, LOG).repartition(batches, "doc_id").coalesce(batches).write.option("maxRecordsPerFile", 5).parquet(log)
    query = ingest.corrections_stream(spark, log, LOG, state, files_per_batch=1)
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(done) >= batches and all(p["stateOperators"][0]["numRowsUpdated"] <= p["numInputRows"] for p in done)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in done) == batches * 5
    written = {r["batch"]: r["count"] for r in spark.read.parquet(f"{state}/state").groupBy("batch").count().collect()}
    assert len(written) >= batches and max(written.values()) <= 5
    assert ingest.current_state(spark, state, max(written), LOG).count() == batches * 5
