"""Prefix scans by row rank: running aggregates per key, whatever the skew.

A plain ``Window.partitionBy(key).orderBy(order)`` puts every row of a key in
one task, so a key holding a third of the data is a third of the job in one
task.  Here the rows are range-partitioned by (key, order): Spark cuts the
sorted table into parts of about equal row numbers, right through a hot key,
however dense or sparse its order values are.  Then

1. each part reports one *border row*: the totals of its first and its last
   key (its inner keys lie in it whole);
2. the border rows, one per part, are combined in part order, which gives the
   carry each part's first key brings along from the parts before;
3. each part is read once more and scanned from its carry, batch by batch.

The ranked rows are checkpointed in between: parts must not be cut anew when a
task runs again.  A task holds one Arrow batch, the driver one row per part.

Supported operations: ``sum`` (of integers, null as 0), ``max``, ``min`` (of
integers), ``first`` and ``last`` (first / last non-null value, any type), each
inclusive or exclusive of the current row, and ``prev`` (the previous row's
value, like ``lag(1)``).  Several scans share one pass.  A null key is a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import checkpoint_dir

PART = "_part"
_LOW = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Scan:
    out: str
    op: str            # sum | max | min | first | last | prev
    value: Column
    inclusive: bool = False


def ranked(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """``df`` cut by rank: range-partitioned by (key, order), sorted, with the number
    of the part (``_part``), and materialised.  Without ``partitions`` the session's
    shuffle partitions, small ones coalesced by AQE."""
    checkpoint_dir(df.sparkSession)
    cut = (partitions, key, order) if partitions else (key, order)
    return df.repartitionByRange(*cut).sortWithinPartitions(key, order).withColumn(PART, F.spark_partition_id()).checkpoint()


def segments(keys: pa.Array) -> np.ndarray:
    """Positions at which a run of equal keys starts (0 first); null equals null."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))


# A carry is None (no row so far) or a 1-tuple of the value.

def combine(op: str, before, after):
    if before is None or after is None:
        return after if before is None else before
    a, b = before[0], after[0]
    if op == "sum":
        return (a + b,)
    if op in ("max", "min"):
        return ((max if op == "max" else min)(a, b),)
    return before if op == "first" else after


def total(op: str, values: pa.Array):
    """Carry of the rows of one key."""
    if not len(values):
        return None
    if op == "prev":
        return (values[-1].as_py(),)
    if op == "sum":
        return (int(values.fill_null(0).to_numpy(zero_copy_only=False).sum()),)
    known = values.drop_null()
    if not len(known):
        return None
    if op in ("first", "last"):
        return (known[0 if op == "first" else -1].as_py(),)
    found = known.to_numpy(zero_copy_only=False)
    return (int(found.max() if op == "max" else found.min()),)


def running(op: str, inclusive: bool, values: pa.Array, starts: np.ndarray, carry) -> pa.Array:
    """The scan over a batch whose keys start at ``starts``; ``carry`` belongs to the first key."""
    n = len(values)
    at = np.arange(n)
    seg = np.zeros(n, dtype=np.int64)
    seg[starts[1:]] = 1
    seg = np.cumsum(seg)
    begin = starts[seg]
    if op == "sum":
        v = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        up = np.cumsum(v)
        out = up - (up[begin] - v[begin]) - (0 if inclusive else v)
        return pa.array(out + np.where(seg == 0, carry[0] if carry else 0, 0), pa.int64())
    if op in ("max", "min"):
        sign = 1 if op == "max" else -1
        known = ~values.is_null().to_numpy(zero_copy_only=False)
        v = np.where(known, sign * values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), _LOW)
        levels, rank = np.unique(v, return_inverse=True)
        top = levels[np.maximum.accumulate(seg * len(levels) + rank) % len(levels)]
        if not inclusive:
            top = np.where(at > begin, np.concatenate(([_LOW], top[:-1])), _LOW)
        if carry:
            top = np.where(seg == 0, np.maximum(top, sign * carry[0]), top)
        return pa.array(sign * np.where(top == _LOW, 0, top), pa.int64(), mask=top == _LOW)
    if op == "prev":
        pick, ok = at - 1, at > begin
        from_carry = (seg == 0) & ~ok
    else:
        known = ~values.is_null().to_numpy(zero_copy_only=False)
        if op == "last":
            pick = np.maximum.accumulate(np.where(known, at, -1))
            pick = pick if inclusive else np.concatenate(([-1], pick[:-1]))
            ok = pick >= begin
            from_carry = (seg == 0) & ~ok
        else:
            pick = np.minimum.reduceat(np.where(known, at, n), starts)[seg]
            ok = pick <= at if inclusive else pick < at
            from_carry = (seg == 0) if carry else np.zeros(n, dtype=bool)
    pool = pa.concat_arrays([values, pa.array([carry[0] if carry else None], values.type)])
    index = np.where(from_carry, n, np.where(ok, pick, 0))
    return pool.take(pa.array(index, pa.int64(), mask=~(ok | from_carry)))


def _borders(cut: DataFrame, key: str, ops: list[str]) -> DataFrame:
    """One row per part: first and last key, whether they are one run, and the totals of both."""
    n = len(ops)

    def run(batches):
        part = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, values = b.column(1), [b.column(2 + i) for i in range(n)]
            starts = segments(keys)
            if part is None:
                part, head_key, head = b.column(0)[0].as_py(), keys[0].as_py(), None
                last, state = head_key, [None] * n
            goes_on = keys[0].as_py() == last
            end = int(starts[1]) if len(starts) > 1 else b.num_rows
            if goes_on:
                state = [combine(o, s, total(o, v.slice(0, end))) for o, s, v in zip(ops, state, values)]
            if len(starts) > 1 or not goes_on:
                head = state if head is None else head
                state = [total(o, v.slice(int(starts[-1]))) for o, v in zip(ops, values)]
                last = keys[b.num_rows - 1].as_py()
        if part is not None:
            whole = head is None
            row = {"part": part, "head": head_key, "tail": last, "whole": whole}
            for i in range(n):
                h, t = (state if whole else head)[i], state[i]
                row |= {f"h{i}": h[0] if h else None, f"hs{i}": h is not None, f"t{i}": t[0] if t else None, f"ts{i}": t is not None}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    spark_types = {f.name: f.dataType for f in cut.schema.fields}
    kinds = [T.LongType() if o in ("sum", "max", "min") else spark_types[f"_pv{i}"] for i, o in enumerate(ops)]
    fields = [T.StructField("part", T.IntegerType()), T.StructField("head", spark_types[key]), T.StructField("tail", spark_types[key]),
              T.StructField("whole", T.BooleanType())]
    for i, k in enumerate(kinds):
        fields += [T.StructField(f"h{i}", k), T.StructField(f"hs{i}", T.BooleanType()), T.StructField(f"t{i}", k), T.StructField(f"ts{i}", T.BooleanType())]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    return cut.select(PART, key, *[f"_pv{i}" for i in range(n)]).mapInArrow(run, schema)


def _carries(borders: list, ops: list[str]) -> dict[int, list]:
    """Carry of each part's first key; parts without one are left out."""
    out, before, key, seen = {}, None, None, False
    for r in sorted(borders, key=lambda r: r["part"]):
        head = [(r[f"h{i}"],) if r[f"hs{i}"] else None for i in range(len(ops))]
        tail = [(r[f"t{i}"],) if r[f"ts{i}"] else None for i in range(len(ops))]
        goes_on = seen and r["head"] == key
        if goes_on:
            out[r["part"]] = before
        before = [combine(o, a, b) for o, a, b in zip(ops, before, head)] if goes_on and r["whole"] else tail
        key, seen = r["tail"], True
    return out


def prefix_scan(df: DataFrame, key: str, order: str, scans: list[Scan], partitions: int | None = None) -> DataFrame:
    """Add one column per ``Scan``: the running aggregate of ``value`` over
    the rows of the same ``key`` up to (``inclusive``) or before the current
    row in ``order``, which must be unique within a key."""
    ops = [s.op for s in scans]
    values = {f"_pv{i}": s.value.cast("bigint") if s.op in ("sum", "max", "min") else s.value for i, s in enumerate(scans)}
    cut = ranked(df.withColumns(values), key, order, partitions)
    carries = _carries(_borders(cut, key, ops).collect(), ops)  # one row per part
    names, at = df.columns, {c: i for i, c in enumerate(cut.columns)}

    def run(batches):
        state, last, first = [None] * len(ops), None, True
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at[key])
            starts = segments(keys)
            if first:
                state, last, first = carries.get(b.column(at[PART])[0].as_py(), state), keys[0].as_py(), False
            if keys[0].as_py() != last:
                state = [None] * len(ops)
            held = [b.column(at[f"_pv{i}"]) for i in range(len(ops))]
            outs = [running(s.op, s.inclusive, v, starts, c) for s, v, c in zip(scans_, held, state)]
            tail = int(starts[-1])
            state = [combine(o, c if tail == 0 else None, total(o, v.slice(tail))) for o, c, v in zip(ops, state, held)]
            last = keys[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([b.column(at[c]) for c in names] + outs, names=names + [s.out for s in scans_])

    scans_ = [Scan(s.out, s.op, None, s.inclusive) for s in scans]  # without columns, which stay on the driver
    kinds = [T.LongType() if s.op in ("sum", "max", "min") else cut.schema[f"_pv{i}"].dataType for i, s in enumerate(scans)]
    schema = T.StructType([f for f in df.schema.fields] + [T.StructField(s.out, k) for s, k in zip(scans, kinds)])
    return cut.mapInArrow(run, schema)
