"""Quiz answers as they arrive: graded, counted per user, kept as totals.

An answer that is delivered again within the watermark counts once. Each batch hands on
the new totals of the users it touched and replaces its own part of the store, so
a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lurewatch.operators.training import grade, score_percent

#: How late an answer, or its copy, may come.
LATENESS = "1 day"


def score_stream(answers: DataFrame, samples: DataFrame, folder: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Keep totals per user of a stream of (event_id, ts, user_id, sample_id, user_answer).

    The query ends once all answers present at its start are counted; start it again with the
    same checkpoint for what came since. A store has one stream.
    """
    once = answers.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    counts = grade(once, samples).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct")).alias("correct")
    )

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # totals only grow, so of a user's rows the last batch's is right
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(folder)

    return (
        counts.writeStream.outputMode("update").foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The newest totals: (user_id, total, correct, incorrect, score_percent)."""
    rows = spark.read.schema("user_id bigint, total bigint, correct bigint, batch_id bigint").parquet(folder)
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("total", "correct"), "batch_id").alias("s")).select("user_id", "s.*")
    return newest.select(
        "user_id", "total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"),
        score_percent(F.col("correct"), F.col("total")).alias("score_percent"),
    )
