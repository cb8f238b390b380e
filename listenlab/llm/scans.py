"""Running sums within keys, whatever a key's share of the rows.

Rows are dealt into range partitions of (key, order), so a hot key spreads over many of them. Each partition is
scanned with numpy, batch by batch; only what its last key has summed up is handed to the partitions behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written


def scanned(rows: DataFrame, key: str, order: list, sums: dict[str, int | None], then: list | None = None) -> DataFrame:
    """Adds to each row the sums of its key's rows up to it, the row included, in the order given.

    ``sums`` names long columns without nulls, which are replaced by their running sums; a number beside a name is the
    modulus, which has at most 31 bits and is above every value. Keys have no nulls; ``order`` must be total but for
    rows that are alike. One row for each partition reaches the driver, and as many are broadcast.
    """
    spark, names = rows.sparkSession, list(sums)
    schema = StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_row", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, held = TaskContext.get().partitionId(), 0, None, {}
        for b in batches:
            if not (n := b.num_rows):
                continue
            keys = b.column(key)
            new = np.ones(n, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1  # -1: goes on from the batch before
            out = {}
            for name in names:
                run = np.cumsum(b.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.concatenate([run[starts] - b.column(name).to_numpy(zero_copy_only=False)[starts], [-held.get(name, 0)]])
                run -= before[of]
                if sums[name]:
                    run %= sums[name]
                out[name], held[name] = pa.array(run), int(run[-1])
            last = keys[n - 1].as_py()
            columns = [out.get(f, b.column(i)) for i, f in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n))], [*b.schema.names, "_part", "_row"])
            seen += n

    part = written(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order, *(then or [])).mapInArrow(scan, schema), "scan")
    ends = part.groupBy("_part").agg(F.min(key).alias("first"), F.max_by(F.struct(key, *names), "_row").alias("last")).orderBy("_part").collect()
    carried, before, held = [], None, [0] * len(names)
    for r in ends:
        if r["first"] != before:
            held = [0] * len(names)
        elif any(held):
            carried.append((r["_part"], r["first"], *held))
        got = [r["last"][n] for n in names]
        held = [a + b for a, b in zip(held, got, strict=True)] if r["last"][key] == r["first"] else got
        held = [x % sums[n] if sums[n] else x for x, n in zip(held, names, strict=True)]
        before = r["last"][key]
    if not carried:
        return part.drop("_part", "_row")
    small = StructType([StructField("_part", LongType()), StructField(key, rows.schema[key].dataType), *[StructField(f"_b_{n}", LongType()) for n in names]])
    more = {n: F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in names}
    more = {n: F.pmod(c, F.lit(sums[n])) if sums[n] else c for n, c in more.items()}
    return part.join(F.broadcast(spark.createDataFrame(carried, small)), ["_part", key], "left").withColumns(more).select(*rows.columns)
