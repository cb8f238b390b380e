"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SCALE = 1 << 20
#: Bytes of text that training collects at most.
MOST_BYTES = 64 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(rows: DataFrame, most: int) -> list:
    """At most ``most`` rows with at most MOST_BYTES of text, the same on every run: those of smallest hash of id and text.

    A text that alone is longer than MOST_BYTES is passed over, so it never leaves the sample empty.
    A threshold on the hash keeps what is sorted near that number, however large the input.
    """
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    n = rows.count()
    h = F.xxhash64("doc_id", "text")
    kept = rows.where(F.pmod(h, F.lit(_SCALE)) < F.lit(min(_SCALE, int(_SCALE * 1.5 * most / max(n, 1)) + 1)))
    first = kept.withColumns({"_h": F.pmod(h, F.lit(_SCALE)), "_g": h}).orderBy("_h", "_g").limit(most)
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("_h", "_g").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_bytes", upto).where(F.col("_bytes") <= MOST_BYTES).drop("_h", "_g", "_bytes").collect()
