"""Threshold-scaled document fingerprints (operator 1), by DataFrame functions alone.

The fingerprint of a text is the sorted set of those hashes of its five-word shingles that lie below a
fixed fraction of the hash range. Fingerprints of parts merge by set union, and because the threshold is
the same for all texts, overlap and containment can be estimated between texts of very unequal length.
A short text may have no hash below the threshold; its smallest hash is kept beside the fingerprint, never in
it, and tells such texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

WIDTH = 5
#: Share of the shingle hashes that is retained.
FRACTION = 0.25
#: Rows of a neighbourhood bucket aimed at, in next_document().
BUCKET_ROWS = 20_000


def with_fingerprint(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """df with column `out`, the retained shingle hashes of column `text`, sorted and distinct, and column
    `out`_least, the smallest shingle hash.

    Words are lower-cased and split at ASCII white space; fewer than five words are one shingle. A text
    without words (null too) has an empty fingerprint and no smallest hash.
    """
    top = -(1 << 63) + int(fraction * (1 << 64))
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    # each step is a column of its own, so that no lambda computes another step once per element; explode()
    # of a single array keeps it so when a later filter on the results is pushed down through the steps
    df = df.withColumn("__w", F.explode(F.array(F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))))
    w = F.col("__w")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (WIDTH - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k if k else i) for k in range(WIDTH)]))
    whole = F.array(F.xxhash64(F.array_join(F.transform(w, lambda h: h.cast("string")), ",")))
    df = df.withColumn("__s", F.when(F.size(w) >= WIDTH, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>")))
    s = F.col("__s")
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.filter(s, lambda h: h < F.lit(top)))))
    return df.withColumn(f"{out}_least", F.array_min(s)).drop("__w", "__s")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts from their fingerprints. Of two empty fingerprints it is 1
    if the smallest hashes are equal too (or neither text has a word), else 0."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    same = F.col(f"{a}_least").eqNullSafe(F.col(f"{b}_least")).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), same).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0)))


def containment(a: str, b: str) -> Column:
    """Estimated share of text a's shingles that text b has too; 1 if a has no word. Where a's fingerprint is
    empty it is 1 if the texts have one smallest hash, else 0."""
    same = (F.col(f"{a}_least").isNull() | F.col(f"{a}_least").eqNullSafe(F.col(f"{b}_least"))).cast("double")
    return F.when(F.size(a) == 0, same).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def merged(fingerprints: Column) -> Column:
    """The fingerprint of a whole from an array of its parts' fingerprints: exactly that of the whole where
    the parts overlap by WIDTH - 1 words, else without the shingles across parts."""
    return F.sort_array(F.array_distinct(F.flatten(fingerprints)))


def as_string(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ",")


def bucket_bounds(key: DataFrame) -> list[int]:
    """Smallest keys of neighbourhood buckets: values that occur, about evenly apart in rank. A few
    numbers for each shuffle partition or BUCKET_ROWS rows reach the driver, never the keys."""
    spark = key.sparkSession
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), key.count() // BUCKET_ROWS)
    low, cuts = key.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()
    return sorted({low, *(cuts or [])} - {None})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, F.least(at + step, F.lit(len(bounds))) - 1) <= key), at + step).otherwise(at))


def next_document(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (with doc_id and text) and next_<column> of the next row by ascending doc_id, after the last
    row that of the first.

    Null doc_ids come first, rows of one doc_id in order of their text. One shuffle: rows go to buckets
    of neighbouring ids, and the first row of each bucket also to the bucket before it.
    """
    df = df.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = bucket_bounds(df.select("key"))
    if not bounds:
        return df.drop("key").select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    own = bucket_of(F.col("key"), bounds)
    df = df.withColumn("bucket", own)
    guest = F.get(F.lit(bounds), F.col("bucket") - 1) == F.col("key")
    before = F.when(F.col("bucket") == 1, F.lit(len(bounds))).otherwise(F.col("bucket") - 1)
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.when(guest, F.struct(before.alias("b"), F.lit(True).alias("guest")))))
    df = df.withColumn("place", F.explode(places)).select("*", "place.b", "place.guest").drop("place", "bucket")
    order = Window.partitionBy("b").orderBy("guest", "key", "text")
    return df.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where(~F.col("guest")).drop("b", "guest", "key")


def compare(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every row of docs, of its edited text (the last quarter of its code points replaced
    by as many of the next row's first ones), and the likenesses.

    Null text counts as empty: empty fingerprint, and likeness 1 to another text without words. Null
    doc_ids come first in the order, repeated ids in order of their text; a single row is its own next.
    An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    df = next_document(with_fingerprint(own, "text", "fp", fraction), ["text", "fp", "fp_least"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("next_text", F.lit(1), quarter)))
    df = with_fingerprint(df.drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fp", fraction)
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("fp").alias("fingerprint"),
        as_string("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        containment("fp", "edited_fp").alias("contained_edited"),
        containment("fp", "next_fp").alias("contained_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
