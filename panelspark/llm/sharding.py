"""Sharding by jump consistent hashing (operator 12), by DataFrame functions alone.

A row's shard follows from its key and the number of shards, without a table of ranges or ring positions:
a generator seeded by the key makes ever longer jumps over the shards, and the last one within the number of
shards is the row's place. With one shard more, a row either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed value: multiplier of the generator (the increment is 1), arithmetic modulo 2 ** 64.
MULTIPLIER = 2862933555777941757
LOW = (1 << 32) - 1
SHARDS = 8
#: Parts of each shard in which slots are counted side by side.
BUCKETS = 4096
#: Copies of one row that are counted as a unit.
COPIES = 10_000


def halves(key: str | Column) -> tuple[Column, Column]:
    """The upper and the lower 32 bits of a long; a null counts as 0."""
    key = F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(0)).cast("long")
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW))


def stepped(high: Column, low: Column) -> Column:
    """struct(high, low) of the generator's next state. The product is summed from parts of at most 62 bits,
    since a long that overflows is an error in ANSI mode."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    m1, m0 = m_low >> 16, m_low & 0xFFFF
    upper = low * m1
    least = low * m0 + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    most = F.shiftrightunsigned(least, 32) + F.shiftrightunsigned(upper, 16) + high * m0 + F.shiftleft((high * m1).bitwiseAND(F.lit(0xFFFF)), 16) + (low * m_high).bitwiseAND(F.lit(LOW))
    return F.struct(most.bitwiseAND(F.lit(LOW)).alias("high"), least.bitwiseAND(F.lit(LOW)).alias("low"))


def jump(key: str | Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. Each row takes one step a jump, about ln(shards) of them;
    the others of its `shards` steps only pass the state on."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    high, low = halves(key)

    def step(s: Column, _: Column) -> Column:
        now = stepped(s["high"], s["low"])
        to = F.floor((s["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(now["high"], 1) + 1).cast("double"))).cast("long")
        return F.when(s["to"] >= shards, s).otherwise(F.struct(now["high"].alias("high"), now["low"].alias("low"), s["to"].alias("at"), to.alias("to")))

    start = F.struct(high.alias("high"), low.alias("low"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda s: s["at"].cast("int"))


def with_shard(rows: DataFrame, key: str, shards: int = SHARDS, out: str = "shard") -> DataFrame:
    """rows with the shard of each as column `out`; no shuffle. A null key counts as the key 0."""
    return rows.withColumn(out, jump(key, shards))


def moved(rows: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """The rows that change their shard when `before` shards become `after`, with columns from_shard and
    to_shard: what has to be copied. Where shards are added, all of these go to added shards."""
    both = with_shard(with_shard(rows, key, before, "from_shard"), key, after, "to_shard")
    return both.where("from_shard <> to_shard")


def write_shards(rows: DataFrame, path: str, key: str, shards: int = SHARDS, files: int = 16) -> None:
    """Writes rows as Parquet under path/shard=<n>/, in at most `files` files a shard.

    Within a shard, rows are dealt by a hash of the whole row, so that neither a frequent key nor a large
    shard is one task's work.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files))
    placed = with_shard(rows, key, shards).withColumn("__salt", salt)
    placed.repartition(shards * files, "shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


def slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The place of every row of docs: doc_id, size (UTF-8 bytes of the text, 0 for null, plus 1),
    text_crc32, law ("key": doc_id and the number of shards decide), shard, slot and grown_shard.

    Slots number a shard's rows from 0 without gaps, in the order of a hash of doc_id and text, so that they
    depend on nothing but the rows. Equal rows are counted before they are shuffled, in units of COPIES, and
    slots are counted in BUCKETS parts of each shard by that hash: neither a frequent doc_id nor a frequent
    text meets in one task. The totals of the parts (shards * BUCKETS rows at most) are broadcast.

    A null doc_id counts as the key 0, a null text as empty; repeated rows get a slot each; an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    own = own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    own = own.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))
    high, low = halves("doc_id")
    # two steps of the generator: of the key, then of what it made of text and part
    own = own.withColumn("h", stepped(high, low)).withColumn("h", stepped(F.col("h.high"), F.col("h.low").bitwiseXOR(F.col("text_crc32")) + F.col("part") % (1 << 20)))
    own = own.withColumn("h", F.col("h.high")).withColumn("bucket", F.shiftrightunsigned("h", 32 - (BUCKETS - 1).bit_length()))
    own = own.withColumn("shard", jump("doc_id", shards)).withColumn("grown_shard", jump("doc_id", shards + 1))
    own = stored(own, "slots")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(totals), ["shard", "bucket"])
    one = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return one.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") + F.col("copy")).alias("slot"), "grown_shard")


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(table(spark, sf_dir, "documents"))
