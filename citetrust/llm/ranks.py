"""Numbers of rows within their group, also where one group holds most of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType

from citetrust.llm.work import stored


def _runs(key: str):
    """For sorted partitions: each row's place in the partition and in its run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, since = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            place = np.arange(at, at + n)
            begin = np.full(n, -1)
            begin[0] = place[0] if at == 0 or keys[0].as_py() != last else since
            fresh = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            begin[fresh] = place[fresh]
            begin = np.maximum.accumulate(begin)
            at, since, last = at + n, int(begin[-1]), keys[n - 1].as_py()
            made = [pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(place - begin), pa.array(begin == 0)]
            names = [*batch.schema.names, "_part", "_at", "_run", "_first"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return run


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 among equal ``key`` (not null) in ascending ``order``, nulls first.

    Rows are dealt out in ranges of key and order, so a group with most of the rows is spread over as many tasks as
    it has ranges; equal rows are kept apart by a random column and numbered in any order. Only the ends of each
    range, a row per shuffle partition, reach the driver; from there each range learns how many rows of its first
    group came before it. No column may be named ``rank`` or begin with an underscore.
    """
    spread = rows.withColumn("_tie", F.rand(11))
    places = [key, *order, "_tie"]
    schema = rows.schema
    for name, kind in (("_part", IntegerType()), ("_at", LongType()), ("_run", LongType()), ("_first", BooleanType())):
        schema = schema.add(name, kind)
    ordered = spread.repartitionByRange(*places).sortWithinPartitions(*places).drop("_tie")
    runs = stored(ordered.mapInArrow(_runs(key), schema), "runs")
    ends = runs.groupBy("_part").agg(
        F.min_by(key, "_at").alias("head"),
        F.max_by(key, "_at").alias("tail"),
        (F.max_by("_run", "_at") + 1).alias("length"),
        F.max_by("_first", "_at").alias("single"),
    )
    carried, before = [], None
    for end in sorted(ends.collect(), key=lambda e: e["_part"]):
        more = 0
        if before is not None and before[0] == end["head"]:
            more = before[1]
            carried.append((end["_part"], more))
        before = (end["tail"], end["length"] + (more if end["single"] else 0))
    table = rows.sparkSession.createDataFrame(carried, "_part int, _more bigint")  # a row per partition at most
    rank = F.col("_run") + F.when(F.col("_first"), F.coalesce("_more", F.lit(0))).otherwise(0)
    return runs.join(F.broadcast(table), "_part", "left").select(*rows.columns, rank.alias("rank"))
