"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 / MOST of all rows, so fewer than MOST keys are; the driver and broadcasts see those only.
MOST = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """left joined with right, whose rows have distinct keys and say in `count` how many rows of left have theirs.

    Rows of hot keys meet the fewer than MOST rows of right by a broadcast, the others by a shuffle. Rows of left
    without a partner go. right should be a written table.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    name = F.xxhash64(*on)
    hot = [r[0] for r in right.where(F.col(count) * MOST > F.lit(total)).select(name).collect()]
    if not hot:
        return left.join(right, on)
    is_hot = name.isin(hot)
    few = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on)
    return few.unionByName(left.where(~is_hot).join(right.where(~is_hot), on))


def join_salted(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined with right by one column; the rows of a hot key of left are dealt to several copies of right's row.

    left should be a written table.
    """
    total = left.count()
    counts = left.groupBy(on).agg(F.count("*").alias("_rows"))
    hot = counts.where((F.col("_rows") * MOST > F.lit(total)) & (F.col("_rows") > MOST)).select(on, F.ceil(F.col("_rows") * MOST / F.lit(max(total, 1))).cast("int").alias("_salts"))
    rows = hot.collect()
    if not rows:
        return left.join(right, on)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [on, "_salt"]).drop("_salt")
