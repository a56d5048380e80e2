"""Resumable scoring of arriving files with Structured Streaming.

Stateless: files are read as they arrive, scored with column expressions, and written batch by batch. The checkpoint records which
files were done, so a restarted query resumes where it stopped. A batch goes to a folder of its own number and replaces what an
interrupted attempt left there, so every batch is in the output exactly once. Its rows are counted while they are written
(an observed metric), and the count goes to a ledger the same way; nothing reads the output again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators.scoring import lexical_logits

LEDGER = "batch_id long, rows long"


def score_stream(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch D10 expressions, applied to a streaming DataFrame."""
    return lexical_logits(stream.select(id_col, tokens(text_col).alias("tokens"))).select(id_col, "l_fake", "l_real")


def ledger_path(checkpoint_dir: str) -> str:
    return f"{checkpoint_dir.rstrip('/')}-ledger"


def ledger(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """(batch_id, rows): the rows scored in each batch so far."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(ledger_path(checkpoint_dir))


def scored_batches(spark: SparkSession, output_dir: str) -> DataFrame:
    """The output of all batches: (id, l_fake, l_real)."""
    return spark.read.parquet(output_dir).drop("batch")


def run_incremental(spark: SparkSession, input_dir: str, schema: str, output_dir: str, checkpoint_dir: str,
                    files_per_batch: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Score every file that has arrived in ``input_dir`` (availableNow), then stop.

    Returns the number of input rows scored in this call (0 when no new file arrived). A batch that an earlier call
    began and did not end counts for the call that ends it.
    """
    scored: dict[int, int] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")
        rows = int(seen.get["rows"])
        done = batch.sparkSession.createDataFrame([(batch_id, rows)], LEDGER).coalesce(1)
        done.write.mode("overwrite").parquet(f"{ledger_path(checkpoint_dir)}/{batch_id}")
        scored[batch_id] = rows

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(input_dir)
    q = (
        score_stream(stream, id_col, text_col).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir).outputMode("append")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return sum(scored.values())
