"""Labelled rows for the classifiers: which to learn from, and a bounded sample of their texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def sample_rows(docs: DataFrame, labels: DataFrame, target: str, rows: tuple[int, int], max_chars: int) -> DataFrame:
    """doc_id, text, label, fold and the label's total number of rows, for at most rows[label] rows of each label.

    Of each class the rows of least xxhash64(doc_id) outside fold 0, texts of over ``max_chars``
    characters left out; so the sample has at most sum(rows) * max_chars characters.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).filter(fold() != 0)
    totals = own.groupBy("label").agg(F.count("*").alias("total"))
    picked = None
    for label in (0, 1):
        part = own.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[label])
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.join(F.broadcast(totals), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    out = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", fold().alias("fold"), "total")
    # A text that stands in several rows of an id would count as often: one stays.
    return out.groupBy("doc_id").agg(F.min(F.struct("text", "label", "fold", "total")).alias("r")).select("doc_id", "r.*")


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: tuple[int, int], max_chars: int) -> pa.Table:
    """:func:`sample_rows` on the driver, in order of ids."""
    return sample_rows(docs, labels, target, rows, max_chars).toArrow().sort_by("doc_id")


def scored(docs: DataFrame, score: "callable", predict_from: float, batch_columns: str = "doc_id long, score double") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``score`` maps the bytes and offsets of texts to numbers."""
    from collections.abc import Iterator

    from .bytes import groups, utf8
    from .storage import small_batches

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score(data, offsets[i : j + 1]))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, batch_columns).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))
