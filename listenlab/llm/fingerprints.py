"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word
shingles. Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles. All of it is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shingle_hashes

K = 128
SHINGLE = 5
#: Most id ranges in which neighbours are looked up; their bounds are the only thing sent to the driver.
RANGES = 32_768
#: Documents in a range if there are few.
RANGE_ROWS = 64


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest shingle hashes, ascending; none for a null or empty text."""
    return F.slice(F.sort_array(shingle_hashes(text, n)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; 1 for two empty sketches, exact if neither set exceeds k shingles together."""
    return let(
        merge(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(a, b), u)).cast("double") / F.size(u)
        ),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range below the k-th."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    j = resemblance(a, b, k)
    both = distinct_shingles(merge(a, b, k), k) * j
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(both / distinct_shingles(a, k), F.lit(1.0)))


def merged(docs: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each group: hashes are cut to the k smallest in each document before they are dealt out."""
    each = docs.select(*by, F.explode(sketch(F.col("text"), k)).alias("_h")).distinct()
    w = Window.partitionBy(*by).orderBy("_h")
    low = each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes' big-endian bytes."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\\s", "")


def next_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _next, _own, _bucket, _key, _tie) with _next the text of the next smaller id.

    After the smallest id comes the largest; null ids count as smallest; rows of one id are ordered by a
    hash of their text. Ids are cut into ranges at ids that exist, so each range's largest id is known,
    and that row is also sent to the range above (``_own`` false there). Each range is one small window:
    one shuffle of the texts, whatever the ids. Only the cuts, at most RANGES numbers, reach the driver.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_key"),
    )
    n, last = rows.agg(F.count("*"), F.max("_key")).first()
    k = max(1, min(RANGES, math.ceil(n / RANGE_ROWS)))
    shares = F.split(F.lit(",".join(repr(i / k) for i in range(1, k + 1))), ",").cast("array<double>")
    cuts = sorted({last, *rows.agg(F.percentile_approx("_key", shares, max(10_000, 20 * k))).first()[0]}) if n else [0]
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # binary search for the number of cuts below the id
    low = F.aggregate(
        jumps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(bounds, at + s - 1) < F.col("_key")), at + s).otherwise(at)
    )
    placed = rows.withColumn("_low", low)
    own = F.struct(F.col("_low").alias("bucket"), F.lit(True).alias("own"))
    copy = F.struct(((F.col("_low") + 1) % len(cuts)).alias("bucket"), F.lit(False).alias("own"))
    to = F.when(F.get(bounds, F.col("_low")) == F.col("_key"), F.array(own, copy)).otherwise(F.array(own))
    dealt = placed.withColumn("_to", F.explode(to)).select(
        "doc_id", "_text", "_key", F.col("_to.bucket").alias("_bucket"), F.col("_to.own").alias("_own"), F.xxhash64("_text").alias("_tie")
    )
    return dealt.withColumn("_next", F.lead("_text").over(_order()))


def _order():
    return Window.partitionBy("_bucket").orderBy(F.col("_own").desc(), F.col("_key").desc(), "_tie")


def fingerprinted(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike their estimates say they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's. A null text counts as empty; an empty text has an empty fingerprint, and
    two of them have likeness 1. Repeated rows give repeated rows; other columns are ignored.
    """
    n = F.length("_text")
    rows = next_texts(docs).withColumn(
        "_edited", F.concat(F.left("_text", n - F.floor(n / 2).cast("int")), F.left("_next", F.floor(n / 2).cast("int")))
    )
    rows = rows.select(
        "doc_id", "_bucket", "_own", "_key", "_tie",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        sketch(F.col("_text"), k).alias("_a"),
        sketch(F.col("_edited"), k).alias("_b"),
    )
    rows = rows.withColumn("_c", F.lead("_a").over(_order())).where("_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("_a")).alias("fingerprint"),
        as_text(F.col("_b")).alias("edited_fingerprint"),
        resemblance(F.col("_a"), F.col("_b"), k).alias("near_edited"),
        resemblance(F.col("_a"), F.col("_c"), k).alias("near_next"),
        distinct_shingles(F.col("_a"), k).alias("shingles"),
        containment(F.col("_a"), F.col("_b"), k).alias("contained_in_edited"),
    )
