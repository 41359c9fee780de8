"""A bounded, seeded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stage

#: Bytes of text that a sample for fitting holds at most; a text above this share of them is not sampled.
SAMPLE_BYTES, ONE_TEXT = 96 << 20, 4


def fold(key: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds; null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label (0 or 1) of at most `rows` labelled documents outside the held-out fold, those
    with the smallest seeded hashes, as far as their whole texts make up SAMPLE_BYTES. Null labels and identifiers
    are left out, as are texts of more than SAMPLE_BYTES / ONE_TEXT, so that no single one takes the place of many;
    of several labels of a document the larger counts, of its rows the one whose text has the smallest hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = stage(known.orderBy(F.xxhash64("id", F.lit(label)), "id").limit(rows), f"labels-{label}")
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id")  # at most `rows` identifiers, each of any number of rows
    one = texts.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = stage(one.where(F.octet_length("text") <= SAMPLE_BYTES // ONE_TEXT), f"sample-{label}")
    order = W.orderBy(F.xxhash64("id", F.lit(label)), "id").rowsBetween(W.unboundedPreceding, 0)  # at most `rows` rows
    held = sample.select("id", F.sum(F.octet_length("text")).over(order).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)
    return sample.join(F.broadcast(held.select("id")), "id", "left_semi")


def blocks(lengths: list[int], most: int):
    """Bounds of consecutive rows of up to `most` characters together; a longer row stands alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
