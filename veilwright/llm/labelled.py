"""Bounded, repeatable samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the decimal text of `doc_id`, modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y, pick): at most `most` labelled documents outside the held-out remainder.

    Labels that are null are left out; an id labelled twice counts with its largest label. The pick is by hash, so it
    is the same on each run. Only (id, label) rows are sorted for it, and they are few enough to be broadcast.

    Of the rows with one id, the one with the smallest text hash counts, so there are `most` rows at most, whatever ids
    repeat. Texts are whole: the sample's bytes are `most` times the mean length of the picked ones.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(remainder(F.col("doc_id"), modulus) != held_out)
    # Ids without a row in `docs` would waste the bound.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked = known.withColumn("pick", F.xxhash64("doc_id")).orderBy("pick", "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # A minimum on the map side: of an id with many rows one text a task is shuffled.
    one = F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("one")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "pick").agg(one).select(
        "doc_id", "one.text", "y", "pick")
