"""Running totals, positions and sliding windows over a global order.

A window function over a whole table, or over one group that holds much of it,
runs in a single task. Here the order is cut into ranges instead: rows are
range-partitioned, totals run within each partition, and the totals of the
partitions before are added. A hot key is just several ranges.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, size_checked

# The driver draws the borders of ranges from a sample of three times ``BORDER_ROWS`` keys
# a range; all rows are sorted, whatever the borders. It holds the samples of at most
# ``AT_ONCE`` ranges, or of one order, at the same time.
BORDER_ROWS, AT_ONCE = 20, 400


def ranged(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` with the partition's number in ``_p``,
    which follows the order. Written out once, so that later passes see the same
    boundaries even if an executor is lost."""
    cols = [F.col(c) for c in order]
    spread = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return cut(spread.withColumn("_p", F.spark_partition_id()))


@contextmanager
def few_border_rows(spark: SparkSession) -> Iterator[None]:
    """Range partitions of plans that run within this draw their borders from
    ``BORDER_ROWS``."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BORDER_ROWS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def running_total(df: DataFrame, order: Sequence[str], weight: Column | None = None, name: str = "upto", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` (default: one a row) over this row and
    all before it in ``order``, which must be a total order of the rows. Null
    weights count as nothing; an empty table stays empty."""
    weight = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    cutup = ranged(df.withColumn("_w", weight.cast("long")), order, parts)
    totals = cutup.groupBy("_p").agg(F.sum("_w").alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_before"))  # one row a partition
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cutup.withColumn("_in", F.sum("_w").over(inside))
        .join(F.broadcast(before), "_p")
        .withColumn(name, F.col("_in") + F.col("_before"))
        .drop("_p", "_w", "_in", "_before")
    )


def null_safe(group: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """The condition that two aliased tables agree in ``group``, null with null."""
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return cond


def placed_values(df: DataFrame, group: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """(group..., value, k, upto, n): each distinct value of each group, how often it
    occurs, how many of the group's values lie up to it, and how many there are. Null
    values have k 0, so that a group of nothing else is kept with n 0; a null group is a
    group. The values are counted before they are sorted in ranges, so a group may hold
    any share of the rows."""
    k = F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0))
    run = cut(running_total(df.groupBy(*group, value).agg(k.alias("k")), [*group, value], F.col("k"), "_upto", parts))
    ends = size_checked(run.groupBy(*group).agg(F.max("_upto").alias("_end"), F.sum("k").alias("n")), 200_000)
    return run.alias("l").join(ends.alias("r"), null_safe(group)).select("l.*", (F.col("_upto") - F.col("_end") + F.col("n")).alias("upto"), "n").drop("_upto")


def value_at(place: Column, value: str) -> Column:
    """Aggregate over ``placed_values``: the value at a place counted from nought in the
    group's sorted values, null beyond them."""
    return F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("k")), F.col(value)))


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place (from 1) within its group by ``order``, without
    gathering any group in one task. ``group + order`` must be total."""
    placed = running_total(df, [*group, *order], name="_pos", parts=parts)
    placed = cut(placed)
    first = size_checked(placed.groupBy(*group).agg(F.min("_pos").alias("_first")), 200_000)
    return placed.alias("l").join(first.alias("r"), null_safe(group)).select("l.*", (F.col("l._pos") - F.col("r._first") + 1).alias(name)).drop("_pos")


def sliding_compare(orders: Sequence[tuple[DataFrame, Sequence[str]]], width: int, compare: Callable, schema: str, parts: int | Sequence[int], chunk: int = 8192, reach: Callable | None = None) -> DataFrame:
    """Runs ``compare`` on windows of ``width`` rows along each of several orders.

    ``orders`` are (DataFrame, sort columns); ``compare(pdf, a_to, b_from)`` gets rows
    in order and yields, in the columns of ``schema``, what it finds for pairs of rows
    less than ``width`` apart of which the first is before row ``a_to`` and the second
    from row ``b_from`` on. ``parts`` are the ranges of every order, or of each. Rows are range-partitioned and streamed, so a task holds
    ``chunk`` rows at a time and a hot key is just several partitions. Each partition
    also hands on its first and last ``width - 1`` rows, and the windows across the
    borders are made up from those in a second, small step. Orders of many ranges are
    run one after another, so that the driver never holds the samples of all of them.

    ``reach(pdf, sort columns)``, if given, says for each row how many rows after it,
    ``width`` apart or more, it must meet too; ``compare`` then gets that as a fourth
    argument. Where a row's reach ends must not come before where the row before it
    ends. As many rows are carried on as reach over a border.
    """

    def over(pdf, order):
        """How many of the last rows those that follow may have to meet."""
        n = len(pdf)
        if reach is None or not n:
            return min(n, width - 1)
        return max(min(n, width - 1), n - int(np.argmax(np.arange(n) + reach(pdf, order) >= n - 1)))

    def run_compare(pdf, a_to, b_from, order):
        return compare(pdf, a_to, b_from) if reach is None else compare(pdf, a_to, b_from, reach(pdf, order))

    def runner(which: int, order: Sequence[str]):
        def run(batches):
            pid = TaskContext.get().partitionId()
            head, carry, n = None, None, 0
            empty, closed = True, False
            for pdf in batches:
                for at in range(0, len(pdf), chunk):
                    part = pdf.iloc[at : at + chunk]
                    if head is None:
                        head = part.head(0)
                        carry = part.head(0)
                    if not closed:
                        head = pd.concat([head, part], ignore_index=True)
                        most = max(width - 1, 0 if reach is None else int(reach(head, order)[0]) + 1)
                        closed = len(head) > most
                        head = head.head(most) if closed else head
                    both = pd.concat([carry, part], ignore_index=True)
                    found = run_compare(both, len(both), len(carry), order)
                    carry = both.tail(over(both, order))
                    n += len(part)
                    empty = False
                    yield found.assign(_order=which, _part=pid, _edge=None)
            if not empty:
                edge = pickle.dumps((head.to_dict("list"), carry.to_dict("list"), n))
                yield pd.DataFrame({**{c.split()[0]: [None] for c in schema.split(", ")}, "_order": [which], "_part": [pid], "_edge": [edge]})

        return run

    full = f"{schema}, _order int, _part int, _edge binary"
    names = [c.split()[0] for c in schema.split(", ")]
    each = [parts] * len(orders) if isinstance(parts, int) else list(parts)
    written, waiting, ranges = [], [], 0
    with few_border_rows(orders[0][0].sparkSession):
        for which, ((df, order), n) in enumerate(zip(orders, each)):
            if waiting and ranges + n > AT_ONCE:
                written.append(cut(reduce(DataFrame.unionByName, waiting)))
                waiting, ranges = [], 0
            waiting.append(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(runner(which, order), full))
            ranges += n
        written.append(cut(reduce(DataFrame.unionByName, waiting)))
    out = reduce(DataFrame.unionByName, written)
    orders_by = [list(order) for _, order in orders]

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        carry, got = None, []
        order = orders_by[int(pdf["_order"].iloc[0])]
        for edge in pdf.sort_values("_part")["_edge"]:
            head, tail, n = pickle.loads(edge)
            head, tail = pd.DataFrame(head), pd.DataFrame(tail)
            if carry is not None and len(carry):
                both = pd.concat([carry, head], ignore_index=True)
                got.append(run_compare(both, len(carry), len(carry), order))
            if carry is None or len(tail) < n:
                carry = tail
            else:  # all rows of the partition reach its end: what came before may still reach over it
                carry = pd.concat([carry, tail], ignore_index=True)
                carry = carry.tail(over(carry, order))
        return pd.concat(got)[names] if got else pd.DataFrame(columns=names)

    inner = out.where("_edge is null").select(*names)
    across = out.where("_edge is not null").select("_order", "_part", "_edge").groupBy("_order").applyInPandas(borders, schema)
    return inner.unionByName(across)
