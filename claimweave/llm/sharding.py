"""Operator 8 [native]: two-pass external shuffle into shards.

Pass 1 scatters records by a seeded hash into buckets of a bounded expected size; the number of buckets
follows the number and the size of the records. Pass 2 shuffles each bucket by Fisher-Yates, drawing from a hash of
the seed, the bucket and the step, and lays the buckets end to end: a record's place is its bucket's offset plus its
place in the bucket, its shard is that place modulo the number of shards and its slot the quotient. So places are a
function of the records and the seed, whatever the partitions, and a task that runs again gives the same ones.
Law `rows`: shards differ by one row at most. DataFrame functions only.

Defined results: a null text has size 8 and the checksum of no bytes; repeated rows are placed each, scattered
by their number among their equals; an empty table gives an empty result; other columns stay only
in write_shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Records and bytes of records in a bucket, expected; a shuffle's work grows with the square of the former.
BUCKET_ROWS, BUCKET_BYTES = 1024, 64 << 20


def permutation(n: Column, *seed: Column) -> Column:
    """The numbers 0 ... n - 1 as Fisher-Yates leaves them: each next one changes places with one drawn from those so far."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        swapped = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, i - j), F.array(F.element_at(done, F.least(j + 1, i))))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(swapped)

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.array(F.lit(0)), step)


def numbered(records: DataFrame) -> DataFrame:
    """records with _copy, a number among equal rows. They are counted before any shuffle, so a row may be repeated at will."""
    equal = records.groupBy(*records.columns).agg(F.count("*").alias("_copies"))
    return equal.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def place(records: DataFrame, key: list[str], shards: int = 24, seed: int = 17, bucket_rows: int = BUCKET_ROWS, size: str | None = None) -> DataFrame:
    """records with shard and slot; `key` names columns that scatter a record, `size` one with its bytes."""
    n, total = records.agg(F.count("*"), F.sum(size) if size else F.lit(0)).first()
    buckets = max(1, -(-n // bucket_rows), -(-(total or 0) // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key, "_copy"), F.lit(buckets))
    scattered = numbered(records).withColumn("_bucket", bucket)
    row = F.struct(*records.columns, "_copy")
    # Sums in two levels, so that no task adds up all buckets.
    sizes = scattered.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_part", F.floor(F.col("_bucket") / 4096))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("_part").agg(F.sum("_n").alias("_all"))
    parts = parts.select("_part", F.coalesce(F.sum("_all").over(before.orderBy("_part")), F.lit(0)).alias("_base"))
    sizes = sizes.withColumn("_own", F.coalesce(F.sum("_n").over(before.partitionBy("_part").orderBy("_bucket")), F.lit(0)))
    offsets = sizes.join(parts, "_part").select("_bucket", (F.col("_base") + F.col("_own")).alias("_offset"))
    packed = scattered.groupBy("_bucket").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    order = permutation(F.size("_rows"), F.lit(seed), F.col("_bucket"))
    shuffled = packed.withColumn("_order", F.when(F.size("_rows") > 1, order).otherwise(F.array(F.lit(0))))
    shuffled = shuffled.select("_bucket", F.transform("_order", lambda i: F.get("_rows", i)).alias("_rows"))
    placed = shuffled.join(offsets, "_bucket").select("_offset", F.posexplode("_rows").alias("_place", "_row"))
    at = F.col("_offset") + F.col("_place")
    return placed.select("_row.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")).drop("_copy")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and eight for its header."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 17) -> DataFrame:
    """A row for each document: id, size, text_crc32, law, shard, slot, grown_shard."""
    records = docs.select(id_col, record_size(F.col(text_col)).alias("size"), text_crc32(F.col(text_col)).alias("text_crc32"))
    placed = place(records, [id_col, "size", "text_crc32"], shards, seed, size="size")
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 17, file_rows: int = 1 << 17) -> None:
    """Writes whole rows into folders shard=0 ... in files of file_rows slots, in the order of their slots, which shard() gives too."""
    key = [id_col, "_size", "_crc"]
    rows = docs.select(F.struct(*docs.columns).alias("_whole"), F.col(id_col), record_size(F.col(text_col)).alias("_size"), text_crc32(F.col(text_col)).alias("_crc"))
    placed = place(rows.select(*key, "_whole"), key, shards, seed, size="_size").select("_whole.*", F.col("shard").alias("shard"), F.col("slot").alias("_slot"))
    part = F.floor(F.col("_slot") / file_rows)
    placed.repartition("shard", part).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
