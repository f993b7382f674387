"""Running sums within groups, for groups of any size.

Rows are dealt into ranges of (group, order), so a large group spreads over many tasks; each range
keeps running values of its own, one row for each range tells what the next ranges carry on from, and
that small table is joined back. No task holds a group; only a key that repeats in all its columns
stays together, so ``order`` should end in something that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from retailcast.llm.common import small_enough, staged

#: Rows of a range, and bytes of the table of ranges up to which its join is a broadcast.
RANGE_ROWS = 1 << 18
BROADCAST_BYTES = 32 << 20


def ranges(rows: int, size: int = RANGE_ROWS) -> int:
    return max(1, -(-rows // size))


def _scan(values: np.ndarray, starts: np.ndarray, carry: int, xor: bool) -> np.ndarray:
    """Running sums (or exclusive-or) that begin anew at ``starts``; the rows before go on from ``carry``."""
    whole = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    ahead = np.concatenate((np.zeros(1, np.int64), whole[:-1]))[starts]
    before = np.concatenate((np.array([carry if xor else -carry], np.int64), ahead))
    base = np.repeat(before, np.diff(np.concatenate(([0], starts, [len(values)]))))
    return whole ^ base if xor else whole - base


def running(df: DataFrame, group: str, order: list[Column], values: dict[str, tuple[str, str]],
            name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with a column for each of ``values``, {new: (long column, "sum" or "xor")}: the sum over the
    rows of the same ``group`` (one column, null a group too) up to and with this one, in ``order``.

    ``df`` is read several times and should be a written table. The result is a written table's join."""
    n = ranges(df.count(), range_rows)
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    added = [StructField(c, LongType()) for c in ("_part", "_at", "_segment", *values)]
    schema = StructType(df.schema.fields + added)
    arrow = to_arrow_schema(StructType(added))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, segment, key, carry = TaskContext.get().partitionId(), 0, 0, None, dict.fromkeys(values, 0)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            column = batch.column(batch.schema.get_field_index(group))
            coded = column.dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = column[0].as_py()
            new = np.concatenate(([at > 0 and first != key], codes[1:] != codes[:-1]))
            starts = np.flatnonzero(new)
            segments = segment + np.cumsum(new)
            out = [np.full(size, part, np.int64), at + np.arange(size), segments]
            for c, (source, how) in values.items():
                given = batch.column(batch.schema.get_field_index(source)).to_numpy(zero_copy_only=False).astype(np.int64)
                got = _scan(given, starts, carry[c], how == "xor")
                carry[c] = int(got[-1])
                out.append(got)
            at, segment, key = at + size, int(segments[-1]), column[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, f.type) for x, f in zip(out, arrow))],
                                             names=schema.fieldNames())

    local = staged(dealt.mapInArrow(scan, schema), name)
    held = [F.col(group).alias("key"), *(F.col(c) for c in values)]
    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(*held), "_at").alias("first"), F.max_by(F.struct(*held), "_at").alias("last"))
    # A range's last group is carried on to later ranges that begin with it.
    asks = ends.select("_part", F.lit(0).alias("gives"), F.col("first.key").alias("key"), *(F.lit(0).cast("long").alias(c) for c in values))
    gives = ends.select("_part", F.lit(1).alias("gives"), F.col("last.key").alias("key"), *(F.col(f"last.{c}").alias(c) for c in values))
    earlier = Window.partitionBy("key").orderBy("_part", "gives")
    sums = {c: (F.bit_xor(c) if how == "xor" else F.sum(c)).over(earlier) for c, (_, how) in values.items()}
    carried = asks.unionByName(gives).select("_part", "gives", *(sums[c].alias(f"_before_{c}") for c in values)).where("gives = 0").drop("gives")
    carried = staged(carried, f"{name}-carried")
    if small_enough(carried, BROADCAST_BYTES, 16 + 8 * len(values)):
        carried = F.broadcast(carried)
    for c, (_, how) in values.items():
        before = F.when(F.col("_segment") == 0, F.col(f"_before_{c}")).otherwise(0)
        sums[c] = (F.col(c).bitwiseXOR(before) if how == "xor" else F.col(c) + before).alias(c)
    return local.join(carried, "_part").select(*df.columns, *(sums[c] for c in values))
