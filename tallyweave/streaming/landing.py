"""New statement files in a landing folder become ledger rows.

Layout of the folder: ``account=<id>/...``. Two streams work one behind the other. The
first reads new files, numbers their lines and notes a fingerprint of each file. The
second reads the fingerprints and keeps the first of each in Spark's keyed state
(RocksDB, partitioned by fingerprint), so a copy under another name is skipped however
long ago its content came: a batch looks up its own fingerprints and reads no earlier
batch. What the second keeps is parsed, classified and written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.classify import build_ledger
from tallyweave.sources.statements import accepted, file_fingerprints, first_copies, numbered, parse_statements, quarantined, with_line_ids

SEEN = "hash string, path string, batch long"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_landing(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines with file path, account and file block. ``max_files`` only paces the batches."""
    stream = spark.readStream.schema("value string, account string")
    stream = stream if max_files is None else stream.option("maxFilesPerTrigger", max_files)
    return (
        stream.text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("account").alias("bank_account_id"),
            "value",
        )
    )


def _done(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _with_settings(spark: SparkSession, settings: dict[str, str], start) -> StreamingQuery:
    """``start()`` under ``settings``, which a query keeps; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, prefixes: dict[str, str],
    bank_accounts: DataFrame, rules: list[tuple[int, str, str, str, str]], max_files: int | None = None,
) -> StreamingQuery:
    """Start the stream over everything present; it ends when all of it is read.

    Writes ``out/lines``, ``out/seen``, ``out/files`` and ``out/quarantine`` by batch and
    ``out/ledger`` by batch and month. Of a content that comes several times in a batch
    the first path is kept. Ids follow from batch, file order and line number.

    A batch run again after a failure gives the same rows: what it noted in ``out/seen``
    stands once complete, the state forgets nothing the second stream has committed, and
    a folder of ``out`` is overwritten by the same batch only.
    """
    replace = {"partitionOverwriteMode": "dynamic"}

    def note(batch: DataFrame, batch_id: int) -> None:
        seen, lines = f"{out}/seen/batch={batch_id}", f"{out}/lines/batch={batch_id}"
        if not _done(spark, seen):
            # Written once: the second stream may have listed the files.
            numbered(batch.withColumn("pos", F.monotonically_increasing_id())).write.mode("overwrite").parquet(lines)
            firsts = first_copies(file_fingerprints(spark.read.parquet(lines)))
            firsts.write.mode("overwrite").parquet(seen)
        _with_settings(spark, STATE, lambda: second(batch_id)).awaitTermination()

    def second(batch_id: int) -> StreamingQuery:
        """What is new in ``out/seen``: this batch, for the ones before were awaited, or nothing if it was done before."""
        fresh = spark.readStream.schema(SEEN).parquet(f"{out}/seen").dropDuplicates(["hash"])
        return (
            fresh.writeStream.option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).foreachBatch(lambda kept, _: write(kept, batch_id)).start()
        )

    def write(kept: DataFrame, batch_id: int) -> None:
        # The state is asked once; what it let through is read back from the files.
        kept.write.mode("overwrite").options(**replace).partitionBy("batch").parquet(f"{out}/files")
        mark = F.lit(batch_id).cast("long")
        files = spark.read.schema(SEEN).parquet(f"{out}/files").where(F.col("batch") == batch_id)
        lines = spark.read.parquet(f"{out}/lines/batch={batch_id}").join(files.select("path"), "path", "left_semi")
        parsed = parse_statements(with_line_ids(lines, batch_id), prefixes)
        ledger = build_ledger(accepted(parsed), bank_accounts, rules).withColumn("batch", mark)
        # One folder per batch and month: a repeated batch replaces what it wrote before.
        ledger.write.mode("overwrite").options(**replace).partitionBy("batch", "month").parquet(f"{out}/ledger")
        bad = quarantined(parsed).withColumn("batch", mark)
        bad.write.mode("overwrite").options(**replace).partitionBy("batch").parquet(f"{out}/quarantine")

    return (
        read_landing(spark, landing, max_files).writeStream.option("checkpointLocation", f"{checkpoint}/landing")
        .trigger(availableNow=True).foreachBatch(note).start()
    )
