"""Running values over rows in order, without a window over a whole file, chromosome or table.

Rows are laid out in order, each with its partition and its place in it. Windows run within partitions only;
what a partition hands on to the next one (its sum, its largest value, its last value) is a row for each group
and partition, and a second, small window over these rows carries it along. Groups (``by``) must lie together
in the order, so there are about as many of these rows as groups and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.operators.storage import PLACE, if_small, placed, stored


def in_order(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted once and written with their places, for scanned()."""
    return stored(placed(df.orderBy(*order)))


def scanned(rows: DataFrame, by: tuple[str, ...] = (), sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Adds columns to rows of in_order() (or rows of a scan of files with their places; they are read twice).

    sums, maxes: over the rows before this one (0 and null at first); previous, following: the value of the
    neighbouring row; last: the last value that isn't null, up to this row. All within a group of ``by``, where
    nulls are a group.
    """
    sums, maxes, previous, following, last = (x or {} for x in (sums, maxes, previous, following, last))
    p, i = PLACE
    inside = Window.partitionBy(p, *by).orderBy(i)
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    boxed = lambda v: F.struct(v.alias("v"))  # noqa: E731  keeps a null value apart from no row
    own = {
        **{f"__s_{n}": F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in sums.items()},
        **{f"__m_{n}": F.max(v).over(before) for n, v in maxes.items()},
        **{f"__b_{n}": F.lag(boxed(v)).over(inside) for n, v in previous.items()},
        **{f"__f_{n}": F.lead(boxed(v)).over(inside) for n, v in following.items()},
        **{f"__l_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in last.items()},
    }
    local = rows.withColumns(own)
    place = F.col(i)
    totals = rows.groupBy(p, *by).agg(
        F.count("*").alias("__rows"),
        *(F.sum(v).alias(f"__s_{n}") for n, v in sums.items()),
        *(F.max(v).alias(f"__m_{n}") for n, v in maxes.items()),
        *(F.max_by(boxed(v), place).alias(f"__b_{n}") for n, v in previous.items()),
        *(F.min_by(boxed(v), place).alias(f"__f_{n}") for n, v in following.items()),
        *(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"__l_{n}") for n, v in last.items()),
    )
    across = Window.partitionBy(*by).orderBy(p)
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(p).alias("__cp"),
        *(F.col(b).alias(f"__c_{b}") for b in by),
        *(F.coalesce(F.sum(f"__s_{n}").over(ahead), F.lit(0)).alias(f"__cs_{n}") for n in sums),
        *(F.max(f"__m_{n}").over(ahead).alias(f"__cm_{n}") for n in maxes),
        *(F.lag(f"__b_{n}").over(across).alias(f"__cb_{n}") for n in previous),
        *(F.lead(f"__f_{n}").over(across).alias(f"__cf_{n}") for n in following),
        *(F.last(f"__l_{n}", ignorenulls=True).over(ahead).alias(f"__cl_{n}") for n in last),
    )
    carry = if_small(stored(carry))
    same = local[p] == carry["__cp"]
    for b in by:
        same = same & local[b].eqNullSafe(carry[f"__c_{b}"])
    joined = local.join(carry, same)
    found = {
        **{n: F.col(f"__s_{n}") + F.col(f"__cs_{n}") for n in sums},
        **{n: F.greatest(f"__m_{n}", f"__cm_{n}") for n in maxes},
        **{n: F.coalesce(f"__b_{n}", f"__cb_{n}")["v"] for n in previous},
        **{n: F.coalesce(f"__f_{n}", f"__cf_{n}")["v"] for n in following},
        **{n: F.coalesce(f"__l_{n}", f"__cl_{n}") for n in last},
    }
    return joined.select(*rows.columns, *(c.alias(n) for n, c in found.items()))
