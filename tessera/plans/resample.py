"""Randomness from hashes: the same at every computation, in any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ticket(seed: int | str, *keys: str | Column) -> Column:
    """A hexadecimal digest of the seed and the keys, whose order is a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int | str, salt: str, *keys: str | Column) -> Column:
    """A number in (0, 1) with 52 random bits."""
    digits = F.substring(ticket(f"{seed}-{salt}", *keys), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """``df`` once for each of 0 to n - 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: Rows up to which a replicate is ranked by one task's sort; more are ranked in slices, with the same result.
ONE_SORT = 100_000


def ranked(rows: DataFrame, by: list[str], key: Column, slice_: Column, name: str = "_at") -> DataFrame:
    """``rows`` with their rank (from 1) by ``key`` and id within the ``by`` columns, counted in slices that are in the key's order."""
    d = rows.withColumns({"_key": key, "_slice": slice_})
    sizes = d.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_key", "id"))
    return d.withColumn("_r", inner).join(sizes, [*by, "_slice"]).withColumn(name, F.col("_r") + F.col("_before")).drop("_key", "_slice", "_r", "_before")


def permuted(values: DataFrame, n: int, seed: int) -> DataFrame:
    """(rep, id, y): for each replicate the values in another order over the ids.

    ``values`` is (id, y). Up to ``ONE_SORT`` rows a replicate is sorted by one
    task and the replicates are spread over the cluster; of more rows both ranks
    are counted in slices, so that no task sorts a whole replicate.
    """
    many = replicates(values.select("id", "y"), n)
    if n == 0:
        return many.select(F.lit(0).alias("rep"), "id", "y").where("false")
    hashed = ticket(seed, "rep", "id")
    if values.limit(ONE_SORT + 1).count() <= ONE_SORT:
        place = many.select("rep", "id", F.row_number().over(Window.partitionBy("rep").orderBy("id")).alias("_at"))
        drawn = many.select("rep", "y", F.row_number().over(Window.partitionBy("rep").orderBy(hashed, "id")).alias("_at"))
        return place.join(drawn, ["rep", "_at"]).select("rep", "id", "y")
    lo, hi = values.agg(F.min("id"), F.max("id")).first()
    width = max(1.0, (hi - lo) / 1023)
    own = ranked(values.select("id", F.lit(0).alias("_all")), ["_all"], F.col("id"), F.floor((F.col("id") - lo) / width)).select("id", "_at")
    drawn = ranked(many, ["rep"], hashed, F.substring(hashed, 1, 3)).select("rep", "y", "_at")
    return drawn.join(own, "_at").select("rep", "id", "y")


def first_drawn(values: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(rep, rank, o, y): the first ``k`` rows of ``values`` (id, y) in each replicate's random order.

    The window's limit is applied in every task before the shuffle, so that a
    replicate's n rows are never sorted together.
    """
    order = Window.partitionBy("rep").orderBy(ticket(seed, "rep", "id"), "id")
    return replicates(values.select("id", "y"), n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rep", "rank", F.col("id").alias("o"), "y")


def p_values(observed: Column, greater: Column, smaller: Column, n: int, alternative: str = "two-sided") -> Column:
    """From the numbers of simulations at least and at most the observed value."""
    up, down = (1 + greater) / (n + 1.0), (1 + smaller) / (n + 1.0)
    if alternative == "greater":
        return up
    if alternative == "less":
        return down
    return F.least(F.lit(1.0), 2 * F.least(up, down))
