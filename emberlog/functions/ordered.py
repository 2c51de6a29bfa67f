"""Order-dependent columns without a window over all rows.

Rows are dealt by a coarse block of the order; a window runs inside each block, and one over the table of blocks (a row
each) carries on from one block to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], block: Column, name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 in the given order; block must be monotone in it."""
    df = df.withColumn("block__", block)
    inside = Window.partitionBy("block__").orderBy(*order)
    before = Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("block__").agg(F.count("*").alias("k__")).select("block__", F.coalesce(F.sum("k__").over(before), F.lit(0)).alias("base__"))
    return df.withColumn(name, F.row_number().over(inside)).join(base, "block__").withColumn(name, (F.col(name) + F.col("base__")).cast("long")).drop("block__", "base__")


def max_before(df: DataFrame, value: Column, order: Column, block: Column, by: list[str], name: str) -> DataFrame:
    """The largest value among the rows of the same group that come before, null if there are none."""
    df = df.withColumn("block__", block).withColumn("value__", value)
    inside = Window.partitionBy(*by, "block__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "block__").agg(F.max("value__").alias("top__")).select(*by, "block__", F.max("top__").over(before).alias("base__"))
    out = df.withColumn(name, F.max("value__").over(inside)).join(base, [*by, "block__"])
    return out.withColumn(name, F.greatest(name, "base__")).drop("block__", "value__", "base__")


def numbered_by(df: DataFrame, by: list[str], order: Column, block: Column, name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 within each group; a hot group is spread over the blocks of its order."""
    df = df.withColumn("block__", block)
    inside = Window.partitionBy(*by, "block__").orderBy(order)
    before = Window.partitionBy(*by).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "block__").agg(F.count("*").alias("k__")).select(*by, "block__", F.coalesce(F.sum("k__").over(before), F.lit(0)).alias("base__"))
    return df.withColumn(name, F.row_number().over(inside)).join(base, [*by, "block__"]).withColumn(name, (F.col(name) + F.col("base__")).cast("long")).drop("block__", "base__")


#: Blocks of values that nearest ranks are counted in: COARSE times as many fine ones as coarse ones.
COARSE = 32


def nearest_rank(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(q, v): the value at sorted index round((n-1) * q), for each q; exact, no list of all values.

    Equal values are counted first, so none of them is a hot key. The distinct ones are dealt to blocks between approximate
    quantiles (COARSE * COARSE numbers, fetched), whatever their range, and counted up inside a block and over the blocks.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n_cuts = COARSE * COARSE
    cuts = rows.agg(F.percentile_approx("v", [k / n_cuts for k in range(1, n_cuts)], 10 * n_cuts).alias("c")).first().c
    if cuts is None:
        return rows.select(F.lit(0.0).alias("q"), "v").limit(0)
    below = lambda x: F.size(F.filter(x, lambda c: c < F.col("v")))
    fine, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[COARSE - 1 :: COARSE]))
    counts = rows.groupBy("v").agg(F.count("*").alias("k")).withColumn("coarse__", below(coarse))
    counts = counts.withColumn("block__", F.col("coarse__") * COARSE + below(F.slice(fine, F.col("coarse__") * COARSE + 1, F.lit(COARSE)))).drop("coarse__")
    inside = Window.partitionBy("block__").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("block__").agg(F.sum("k").alias("k__")).select("block__", F.coalesce(F.sum("k__").over(before), F.lit(0)).alias("base__"))
    ranked = counts.withColumn("last", F.sum("k").over(inside)).join(base, "block__").select("v", (F.col("last") + F.col("base__")).alias("last"), "k")
    total = rows.agg(F.count("*").alias("n"))
    wanted = total.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), (F.round((F.col("n") - 1) * F.lit(q)) + 1).cast("long").alias("n")) for q in quantiles))).alias("x")).select("x.*")
    return ranked.join(F.broadcast(wanted), (F.col("n") <= F.col("last")) & (F.col("n") > F.col("last") - F.col("k"))).select("q", "v")
