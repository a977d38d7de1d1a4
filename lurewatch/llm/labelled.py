"""Labelled training texts: a sample of bounded size, joined to the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEPS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of about `max_rows` labelled documents, the same ones in every run.

    `allowed` is a condition on doc_id. Rows are chosen by a hash of the id, before
    texts are read; so few ids, bounded by `max_rows`, go to all tasks. Rows without
    a label are left out; a document with several labels counts once for each.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & allowed)
    count = known.count()
    share = STEPS if count <= max_rows else STEPS * max_rows // count
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
