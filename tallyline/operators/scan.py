"""Ordered scans over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  One team,
league or pair may own a third of all rows, so every history operator is built
from the two scans below, which split a key into bounded pieces and stay exact:

* ``running`` - running aggregates.  The rows are range-partitioned over (key,
  order) into pieces of about ``PIECE`` rows, each piece of a key is aggregated
  on its own, and the totals of the earlier pieces (one small row per key and
  piece) are joined back as the carry.  A piece can end anywhere, also inside a day.
* ``last_n`` - frames over the last n valid rows.  The key is cut into blocks
  of valid-row ordinals; the n valid rows before a block are copied into it.
  Rows that are not valid share an ordinal; a block with too many of them is split
  and every part gets the block's valid rows.

Both read ``df`` more than once or wide, so hand in a stored table (``stage``).
Key columns must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.staging import stage

BLOCK = 1 << 20
# rows of a key that one task scans in order
PIECE = 1 << 20

# kind -> (aggregate, how a carried value joins the local one)
_AGGREGATE = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}


def _over_rows(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _AGGREGATE[kind](value).over(window)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return _AGGREGATE[kind](value)


def _carry(kind: str, total: Column, window) -> Column:
    if kind == "last":
        return F.last(total, ignorenulls=True).over(window)
    return _AGGREGATE["sum" if kind == "count" else kind](total).over(window)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "count":
        return local + F.coalesce(carry, F.lit(0).cast("bigint"))
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def larger_than(df: DataFrame, n: int) -> bool:
    """Whether there are more rows; of a stored table, also behind windows over it, a count reads no column."""
    return df.count() > n


def in_pieces(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``__piece``: ranges over ``by`` of about ``PIECE`` rows, numbered in order.

    Written once, because two evaluations of a range partitioning may cut differently.
    """
    pieces = -(-df.count() // PIECE)
    return stage(df.repartitionByRange(pieces, *by).withColumn("__piece", F.spark_partition_id()), "pieces")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            aggregates: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add running aggregates over the rows before each row (or up to it).

    ``order`` must be total within a key.
    """
    unit_names = ["__piece"]
    if not larger_than(df, PIECE):  # one piece has nothing to carry
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select("*", *[_over_rows(kind, value, rows).alias(name) for name, (kind, value) in aggregates.items()])
    cut = in_pieces(df, [*keys, *order])
    rows = (Window.partitionBy(*keys, *unit_names).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = cut.select("*", *[_over_rows(kind, value, rows).alias(f"__local_{name}")
                              for name, (kind, value) in aggregates.items()])
    totals = cut.groupBy(*keys, *unit_names).agg(
        *[_total(kind, value, order).alias(f"__total_{name}") for name, (kind, value) in aggregates.items()])
    earlier = (Window.partitionBy(*keys).orderBy(*unit_names)
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(
        *keys, *unit_names,
        *[_carry(kind, F.col(f"__total_{name}"), earlier).alias(f"__carry_{name}")
          for name, (kind, _) in aggregates.items()])
    joined = local.join(carried, [*keys, *unit_names], "left")
    return joined.select(
        *df.columns,
        *[_combine(kind, F.col(f"__local_{name}"), F.col(f"__carry_{name}")).alias(name)
          for name, (kind, _) in aggregates.items()])


def last_n(df: DataFrame, keys: Sequence[str], ordinal: str, valid: Column, n: int,
           build: Callable[[Callable[[int], object]], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """Add aggregates over the last ``n`` valid rows before each row.

    ``ordinal`` counts the valid rows before a row (see ``running``).  ``build``
    receives ``frame(m)``, the window of the last m <= n valid rows, and returns
    the new columns; values must be null on rows that are not valid.
    """
    block = max(block, n)
    k = F.col(ordinal)
    home = F.floor(k / F.lit(block))
    spills = valid & (k % block >= block - n)
    # rows that are not valid share an ordinal, so their number in a block has no bound of its own
    crowds = (df.where(~valid).groupBy(*keys, home.alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
              .where(F.col("__n") > PIECE).withColumn("__parts", F.ceil(F.col("__n") / PIECE).cast("int")).drop("__n"))
    crowded = larger_than(df, PIECE) and not crowds.isEmpty()  # else no crowd can exceed a piece
    blocked = df.select("*", F.explode(F.when(spills, F.array(home, home + 1)).otherwise(F.array(home)))
                        .alias("__block"))
    part: list[str] = []
    if crowded:
        part = ["__part"]
        row = [c for c, t in df.dtypes if not t.startswith("map")]
        own = F.pmod(F.xxhash64(*row), F.coalesce("__parts", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
        blocked = (blocked.join(crowds, [*keys, "__block"], "left").withColumn("__own", own)
                   .withColumn("__part", F.explode(F.when(valid, every).otherwise(F.array("__own")))))
    window = Window.partitionBy(*keys, "__block", *part).orderBy(ordinal)
    columns = build(lambda m: window.rangeBetween(-m, -1))
    read = blocked.select("*", *[c.alias(name) for name, c in columns.items()]).where(F.col("__block") == home)
    if crowded:
        read = read.where(F.col("__part") == F.col("__own"))
    return read.select(*df.columns, *columns)


def _tidy(value: Column) -> Column:
    return F.rint(value * 1e10) / 1e10


def ema(df: DataFrame, keys: Sequence[str], ordinal: str, valid: Column, values: dict[str, Column],
        alpha: float) -> DataFrame:
    """Exponential moving average of the valid rows, seeded by the first one.

    Adds ``<name>_before`` (state a row may read) and ``<name>_after`` (state it
    leaves, null unless valid).  A value m rows back weighs (1-alpha)**m, which is
    below double precision after ``reach`` rows, so a block needs only those.
    States are rounded to ten decimals so that thresholds see 3 as 3.
    """
    keep = 1.0 - alpha
    reach = math.ceil(math.log(1e-20) / math.log(keep))
    k = F.col(ordinal)
    home = F.floor(k / F.lit(reach))
    blocked = df.select("*", F.explode(F.when(valid, F.array(home, home + 1)).otherwise(F.array(home)))
                        .alias("__block"))
    # position inside the block, counting the copied rows of the block before it
    position = (k - (F.col("__block") - 1) * reach).cast("double")
    before = (Window.partitionBy(*keys, "__block").orderBy(ordinal)
              .rangeBetween(Window.unboundedPreceding, -1))
    weight = F.when(k == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    states = []
    for name, value in values.items():
        term = F.when(valid, weight * value * F.pow(F.lit(keep), -position))
        states.append(_tidy(F.pow(F.lit(keep), position - 1) * F.sum(term).over(before)).alias(f"{name}_before"))
    read = blocked.select("*", *states).where(F.col("__block") == home).drop("__block")
    return read.select("*", *[
        F.when(valid, F.when(k == 0, value).otherwise(
            _tidy(F.lit(alpha) * value + F.lit(keep) * F.col(f"{name}_before"))))
        .alias(f"{name}_after") for name, value in values.items()])
