"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import discard, stored

#: ASCII white space as the contracts name it: ``\x20\x09-\x0D``.
SPACE = " \t\n\x0b\x0c\r"


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Run a Python function over each row of ``df``; each call returns a list of result rows.

    ``make()`` is called once a task (load models and automata there). Results leave in slices, so
    that a worker holds one Arrow batch of input and a bounded number of output rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out: list[tuple] = []
                for args in zip(*(c.to_pylist() for c in part.columns)):
                    out += row(*args)
                if out:
                    cols = [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)`` (any comparable type): (node, component).

    Alternating large-star and small-star steps; each round is two aggregations and two joins over
    the edges left, stored in the shared folder. A node is linked to the smallest node it can reach.
    Isolated nodes do not occur. Edge lists of one node are never gathered: its least neighbour is
    a partial aggregate, and the join that hands it back is one that Spark may split.
    """
    cur = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    seen = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every greater neighbour of u gets u's least neighbour (or u itself)
        least = stored(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label
        )
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            label,
        )
        # small star: the smaller neighbours of u, and u, get the least of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), label)
        joined = large.join(low, "u")
        nxt = stored(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            label,
        )
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for old in (cur, least, large, low):
            discard(old)
        cur = nxt
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def ranked(df: DataFrame, col: str) -> DataFrame:
    """``df`` (one row a value) with ``rank`` from 0 by code point, null last, without a single-task sort."""
    null = F.col(col).isNull()
    dealt = stored(df.repartitionByRange(null, F.col(col)).withColumn("__pid", F.spark_partition_id()), "ranked")
    within = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__pid").orderBy(null, F.col(col))))
    # as many rows as the exchange had partitions
    before = dealt.groupBy("__pid").count().withColumn(
        "__before", F.sum("count").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    )
    return within.join(before, "__pid").select(
        *df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__at") - 1).cast("long").alias("rank")
    )
