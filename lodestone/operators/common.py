"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and bytes of them as text, up to which a side may be broadcast; both are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows, and these at most `size` bytes as text; to be asked of cheap plans, since it runs one."""
    own = F.octet_length(F.struct(*(F.col(f"`{c}`") for c in df.columns)).cast("string"))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(own), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it fits(); else left to the optimizer."""
    return F.broadcast(df) if fits(df, rows) else df


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*by) if by else Window
    return df.withColumn(name, F.row_number().over(window.orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle."""
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def numbered(df: DataFrame, by: str, order: str, name: str = "at", width: int = 4096) -> DataFrame:
    """df with the place of each row in its group, from 0, by `order`, a long column that differs in a group. Ranked in parts of `width` values of it, so that a large group is spread over tasks;
    only the parts of a group, one row each, meet in one."""
    part = df.withColumn("_part", F.floor(F.col(order) / width))
    sizes = part.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_part", (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = ranked(part, [by, "_part"], [order], "_own")
    return own.join(before, [by, "_part"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def in_order(rows: DataFrame, order: list[Column | str], name: str = "at", keep=None) -> DataFrame:
    """rows with the place of each, from 0, in the order of all of them; equal rows by chance. Rows are sorted in ranges of `order`, which are written down, and counted; only the counts, one for each range, meet in one place.
    keep: writes a table down and reads it again, by default sources.staging.staged()."""
    if keep is None:
        from lodestone.sources.staging import staged as keep
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    split = placed.withColumns({"_range": F.shiftright("_id", 33), "_own": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = sorted((r["_range"], r["count"]) for r in split.groupBy("_range").count().collect())  # a row for each range
    before, total = [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_range long, _before long"))
    return split.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_id", "_range", "_own", "_before")
