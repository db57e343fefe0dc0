"""Structured Streaming over the ledger (ST1-ST4).

The reference maintains stock with per-row triggers; here the ledger is a
stream and the same effects are incremental queries:

* ST1 ``live_stock``: running signed sum per product (commutative, so late
  rows need no watermark; state is one long per product).
* ST2 ``ordered_guard``: the negative-stock guard in id order, whatever order
  files arrive in.  The id is the event time: its watermark trails the largest
  id by ``displacement`` ids, rows wait in state by id range, one packed value for
  each, until the watermark has passed their range; then the products of a bucket
  are judged together from their balances, one state row for each bucket.
  ``live_guard`` judges on arrival instead: in id order inside a micro-batch,
  micro-batches as they come (files of equal modification time have no order).
* ST3 ``low_stock_sink``: every micro-batch of ST1's updated stocks joined
  to the (static) product table; products at or below their reorder level
  are written as alerts.
* ST4 ``audit_rows``: audit rows from ST2's accepted rows; ``each_id_once`` drops
  repeated ledger ids (a file delivered twice) while they wait, before they are judged.

Each run takes an output folder and a checkpoint folder; by default the
checkpoint lies in the output (``_checkpoint``), so a run into the same output
resumes after the last batch.  Without an output folder a fresh one under
``spark.checkpoint.dir`` is used.  Sinks are idempotent per batch id (a retried
batch overwrites its own output).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

import larder
from larder.functions.columns import signed_quantity
from larder.operators.audit import product_audit_from_guard
from larder.operators.guard import CHECK, NO_PRODUCT, REFUSED, fold_balances, fold_segments
from larder.session import DEFAULTS, checkpoint_dir
from larder.sources import model as M

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def events_path(sf_dir: str) -> str:
    """The events table, a folder of part files or one file.  A pattern that matches
    just this name: the file source takes a plain path for a folder only."""
    return f"{sf_dir.rstrip('/')}/events.parque[t]"


def ledger_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64,
                  max_bytes_per_trigger: str | None = None) -> DataFrame:
    """The files of a table, and those that arrive, read as a stream and laid out
    as ledger rows.  Every file under ``path`` counts, whatever its name.  The
    options bound a micro-batch (files, or bytes such as "8g")."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return M.ledger_events(reader.parquet(path))


def _folders(spark: SparkSession, name: str, out_path: str | None, checkpoint: str | None) -> tuple[str, str]:
    out_path = out_path or scratch_path(spark, name)
    return out_path, checkpoint or f"{out_path.rstrip('/')}/_checkpoint"


# -- ST1 -------------------------------------------------------------------------

def live_stock(ledger: DataFrame) -> DataFrame:
    """Streaming signed sum per product (update or complete mode)."""
    return ledger.groupBy("product_id").agg(F.sum(signed_quantity()).cast("bigint").alias("stock"))


def run_live_stock(spark: SparkSession, ledger: DataFrame, out_path: str | None = None,
                   checkpoint: str | None = None, compact_every: int = 64) -> str:
    """Run ST1 to completion on the available input, in update mode: each
    micro-batch writes only the products whose stock changed, under
    ``batch_id=N`` (a retried batch overwrites its own folder).  The output
    is a changelog; ``latest_stock`` reads the current stock from it.  (Complete
    mode would rewrite every product's row in every micro-batch.)

    Every ``compact_every`` batches the batch also writes a snapshot of all
    stocks beside the changelog, made of the snapshot before and the batches
    since, and commits it by one row in the list of snapshots.  A batch that
    fails between the two leaves a snapshot nobody reads, and its retry replaces it."""
    out_path, checkpoint = _folders(spark, "live-stock", out_path, checkpoint)
    spark.createDataFrame([], "upto bigint").write.mode("ignore").parquet(_committed(out_path))

    def write(batch: DataFrame, batch_id: int) -> None:
        # the folder name carries batch_id as a partition column
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(spark, out_path, batch_id)

    q = (live_stock(ledger).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def _snapshots(out_path: str) -> str:
    return f"{out_path.rstrip('/')}-snapshots"


def _committed(out_path: str) -> str:
    return f"{out_path.rstrip('/')}-committed"


def last_snapshot(spark: SparkSession, changelog_path: str) -> int | None:
    """Batch id of the newest committed snapshot."""
    try:
        return spark.read.schema("upto bigint").parquet(_committed(changelog_path)).agg(F.max("upto")).first()[0]
    except AnalysisException:  # a changelog from before snapshots
        return None


def compact(spark: SparkSession, changelog_path: str, upto: int) -> None:
    """Write the stocks after batch ``upto`` as a snapshot and commit it."""
    state = latest_stock(spark, changelog_path, upto)
    state.write.mode("overwrite").parquet(f"{_snapshots(changelog_path)}/upto={upto}")
    spark.createDataFrame([(upto,)], "upto bigint").coalesce(1).write.mode("overwrite").parquet(f"{_committed(changelog_path)}/n={upto}")


def latest_stock(spark: SparkSession, changelog_path: str, upto: int | None = None) -> DataFrame:
    """Current stock per product (or that after batch ``upto``): the newest snapshot
    and the batches after it, the row of the highest batch id per product (a hash
    aggregate; no sort, no window).  Older batches are pruned by their folder."""
    log = spark.read.parquet(changelog_path)
    log = log.select("product_id", "stock", F.col("batch_id").cast("bigint").alias("batch_id"))
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    start = last_snapshot(spark, changelog_path)
    if start is not None and (upto is None or start < upto):
        snapshot = spark.read.schema("product_id bigint, stock bigint").parquet(f"{_snapshots(changelog_path)}/upto={start}")
        log = log.where(F.col("batch_id") > start).unionByName(snapshot.withColumn("batch_id", F.lit(start).cast("bigint")))
    return log.groupBy("product_id").agg(F.max_by("stock", "batch_id").alias("stock"))


# -- ST2 -------------------------------------------------------------------------

GUARD_OUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("stock_before", T.LongType()),
    T.StructField("stock_after", T.LongType()),
    T.StructField("reason", T.StringType()),
])
GUARD_STATE = T.StructType([T.StructField("balance", T.LongType())])
_SIGN = {"IN": 1, "OUT": -1, "ADJUSTMENT": 1}


def _judge(pdf: pd.DataFrame, balance: int | None):
    """Sort one product's rows of a micro-batch by id and fold them from the
    stored balance (or the opening stock on first sight)."""
    pdf = pdf.sort_values("id", kind="stable")
    if balance is None:
        first = pdf["opening_stock"].iloc[0]
        balance = int(first) if pd.notna(first) else 0
    # rows that break a CHECK, or name no product, are refused and leave the balance as it is
    sign, known = pdf["transaction_type"].map(_SIGN), pdf["opening_stock"].notna()
    valid = (sign.notna() & (pdf["quantity"].fillna(0) > 0)).to_numpy()
    right = valid & known.to_numpy()
    s = np.where(right, sign.fillna(0) * pdf["quantity"].fillna(0), 0).astype(np.int64)
    acc, before, after, balance = fold_balances(balance, s)
    reason = np.where(~valid, CHECK, np.where(~right, NO_PRODUCT, np.where(~acc, REFUSED, None)))
    acc = acc & right
    judged = pd.array(before, dtype="Int64"), pd.array(after, dtype="Int64")
    for x in judged:
        x[~right] = pd.NA
    before, after = judged
    out = pd.DataFrame({
        "id": pdf["id"].to_numpy(), "product_id": pdf["product_id"].to_numpy(),
        "transaction_type": pdf["transaction_type"].to_numpy(), "quantity": pdf["quantity"].to_numpy(),
        "accepted": acc, "stock_before": before, "stock_after": after, "reason": reason,
    })
    return out, balance


def _guard_state_fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(pdfs), ignore_index=True)
    out, balance = _judge(pdf, state.get[0] if state.exists else None)
    state.update((balance,))
    yield out


class GuardProcessor(StatefulProcessor):
    """ST2 with ``transformWithStateInPandas``: a ValueState holds the balance."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", GUARD_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        current = self.balance.get()[0] if self.balance.exists() else None
        out, balance = _judge(pdf, current)
        self.balance.update((balance,))
        yield out

    def close(self) -> None:
        pass


def _with_processor(rows: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType | str, time_mode: str) -> DataFrame:
    """``transformWithStateInPandas`` per ``key``.  Before the first batch Spark sets the
    processor up in a Python process of the driver, which is not given the files of
    ``addPyFile``: the processor travels by value, so that process need not import us."""
    cloudpickle.register_pickle_by_value(larder)
    try:  # pickled by this call
        return rows.groupBy(key).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=time_mode)
    finally:
        cloudpickle.unregister_pickle_by_value(larder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """Streams that start inside run with a setting; the session's stays as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which several states and
    timers per product need, whatever the session's state store; that stays as it was.
    A query that resumes keeps the store of its checkpoint."""
    if "RocksDB" in spark.conf.get(STATE_STORE, ""):
        yield
        return
    with _set(spark, STATE_STORE, DEFAULTS[STATE_STORE]):
        yield


def live_guard(ledger: DataFrame, opening: DataFrame, api: str = "applyInPandasWithState") -> DataFrame:
    """Streaming guard: one output row per ledger row (append mode).  The
    opening stock comes from a static (product_id, opening_stock) table via
    a stream-static join; it seeds a product's state on first sight.

    ``api``: ``applyInPandasWithState`` (any state store) or
    ``transformWithState`` (``transformWithStateInPandas``; needs the RocksDB
    state store, see ``rocksdb_state``)."""
    # after the left join a product without an opening stock is an unknown one
    op = opening.select(F.col("product_id").alias("_opid"), F.coalesce(F.col("opening_stock"), F.lit(0)).cast("bigint").alias("opening_stock"))
    rows = ledger.select("id", "product_id", "transaction_type", "quantity")
    j = rows.join(op, rows.product_id == op._opid, "left").drop("_opid")
    if api == "transformWithState":
        return _with_processor(j, "product_id", GuardProcessor(), GUARD_OUT, "None")
    return j.groupBy("product_id").applyInPandasWithState(
        _guard_state_fn, GUARD_OUT, GUARD_STATE, "append", GroupStateTimeout.NoTimeout)


# -- ST2 in id order -------------------------------------------------------------

DISPLACEMENT = 1 << 16  # ids by which a row may come late
RANGE = 1 << 16         # ids that wait together: a range in state, and in memory, is at most so many rows
BUCKETS = 1 << 10       # groups of products whose balances lie together
AT_ONCE = 1 << 18       # rows of a bucket that are folded together
CLOSING_ID = 9 * 10**12  # beyond all ids; read as milliseconds the largest round number that pandas can hold

_WAITING = "id bigint, product_id bigint, named boolean, transaction_type string, quantity double"
_WAITING_ARROW = pa.schema([("id", pa.int64()), ("product_id", pa.int64()), ("named", pa.bool_()),
                            ("transaction_type", pa.string()), ("quantity", pa.float64())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows.combine_chunks())
    return out.getvalue().to_pybytes()


class RangeProcessor(StatefulProcessor):
    """The rows of a range of ``ids`` ids, each id once, held as one packed value until
    the watermark has passed the range; then they leave, sorted.  Memory holds one
    range and one chunk of input."""

    def __init__(self, ids: int):
        self.ids = ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen = self.waiting.get(), np.zeros(self.ids, dtype=bool)
        kept = [pa.ipc.open_stream(bytes(held[0])).read_all()] if held else []
        for t in kept:
            seen[t["id"].to_numpy() - key[0] * self.ids] = True
        for pdf in rows:
            at = pdf["id"].to_numpy(dtype=np.int64) - key[0] * self.ids
            first = np.unique(at, return_index=True)[1]  # of each id in the chunk
            first = first[~seen[at[first]]]
            seen[at[first]] = True
            if len(first):
                kept.append(pa.Table.from_pandas(pdf.iloc[first], _WAITING_ARROW, preserve_index=False))
        if len(kept) > (held is not None):
            self.waiting.update((_packed(pa.concat_tables(kept)),))
        if held is None:
            self.handle.registerTimer((key[0] + 1) * self.ids)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.waiting.get()
        self.waiting.clear()
        yield pa.ipc.open_stream(bytes(held[0])).read_all().sort_by("id").to_pandas()

    def close(self) -> None:
        pass


def each_id_once(ledger: DataFrame, displacement: int = DISPLACEMENT) -> DataFrame:
    """The ledger under a watermark over its ids (id n as millisecond n + 1), each id once
    and by ranges of ids: a range leaves when the watermark has passed it, so every
    micro-batch has higher ids than those before.  A repeat is dropped: near its first
    beside it in its range, later because it lies behind the watermark, where new rows
    are not expected any more.  Ids are unique, not null, not negative and below
    ``CLOSING_ID``."""
    at = F.timestamp_millis(F.col("id") + 1)  # what lies at 0 counts as late from the start
    # a product without an id is told by ``named``: pandas has no integers with nulls
    rows = ledger.withColumn("_at", at).withWatermark("_at", f"{displacement} milliseconds").select(
        F.expr(f"id div {RANGE}").alias("range"), "id", F.coalesce(F.col("product_id"), F.lit(0).cast("bigint")).alias("product_id"),
        F.col("product_id").isNotNull().alias("named"), "transaction_type", F.col("quantity").cast("double").alias("quantity"), "_at")
    once = _with_processor(rows, "range", RangeProcessor(RANGE), _WAITING, "EventTime")
    return once.select("id", F.when(F.col("named"), F.col("product_id")).alias("product_id"), "transaction_type",
                       F.col("quantity").cast("int").alias("quantity"))


def in_id_order(chunks: Iterator[pd.DataFrame], at_once: int) -> Iterator[pd.DataFrame]:
    """The rows of ``chunks`` in frames of about ``at_once`` rows, each with higher ids than
    the one before.  More rows than that go through sorted runs on the task's local disk."""
    held, n, runs, ids = [], 0, [], []
    with tempfile.TemporaryDirectory(prefix="ledger-") as folder:
        for pdf in chunks:
            held.append(pdf)
            n += len(pdf)
            if n >= at_once:
                run = pa.Table.from_pandas(pd.concat(held, ignore_index=True).sort_values("id", kind="stable"), preserve_index=False)
                name = os.path.join(folder, str(len(runs)))
                with pa.ipc.new_file(name, run.schema) as w:
                    w.write_table(run)
                runs.append(pa.ipc.open_file(pa.memory_map(name)).read_all())
                held, n = [], 0
        last = [pd.concat(held, ignore_index=True)] if held else []
        if not runs:
            yield from last
            return
        runs += [pa.Table.from_pandas(x.sort_values("id", kind="stable"), preserve_index=False) for x in last]
        ids = [t["id"].to_numpy() for t in runs]
        step = max(1, at_once // (2 * len(runs)))  # between two cuts lie at most len(runs) samples and less than a step of each run
        cuts = np.unique(np.sort(np.concatenate([x[::step] for x in ids]))[::len(runs)])
        at = [np.concatenate((np.searchsorted(x, cuts), [len(x)])) for x in ids]
        for k in range(len(cuts)):
            yield pa.concat_tables([t.slice(a[k], a[k + 1] - a[k]) for t, a in zip(runs, at)], promote_options="permissive").to_pandas()


BUCKET_STATE = T.StructType([T.StructField(c, T.BinaryType()) for c in ("products", "balances", "known")])


def _fold(pdf: pd.DataFrame, stocks: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """Judge rows of many products from their ``stocks`` (ids in order, balances, whether
    there is such a product): ``_judge`` for all of them at once."""
    # rows without a product are one group more, which is not kept
    order = np.lexsort((pdf["id"], pdf["product_id"], pdf["named"]))
    c = {name: pdf[name].to_numpy()[order] for name in pdf.columns}
    product, named, valid = c["product_id"], c["named"], c["valid"]
    starts = np.concatenate(([0], np.flatnonzero((product[1:] != product[:-1]) | (named[1:] != named[:-1])) + 1))
    ends = np.append(starts[1:], len(product))
    ids, balances, known = stocks
    first = product[starts]
    at = np.searchsorted(ids, first)
    old = named[starts] & (at < len(ids)) & (np.append(ids, 0)[at] == first)
    stock = np.where(old, np.append(balances, 0)[at], c["opening_stock"][starts])
    there = named[starts] & np.where(old, np.append(known, False)[at], c["known"][starts])
    # rows that break a CHECK, or name no product, are refused and leave the balance as it is
    right = valid & np.repeat(there, ends - starts)
    judged, s = right.copy(), c["signed"]
    for k in np.flatnonzero(there & (stock < 0)):  # below zero all is refused up to the row that lifts it
        row = slice(starts[k], ends[k])
        lift = np.flatnonzero(right[row] & (s[row] >= -stock[k]))
        judged[starts[k]:starts[k] + lift[0] if len(lift) else ends[k]] = False
    accepted, before, after, _ = fold_segments(stock, np.where(judged, s, 0), judged, starts)
    reason = np.full(len(product), None, dtype=object)
    for rows, why in ((right & ~accepted, REFUSED), (valid & ~right, NO_PRODUCT), (~valid, CHECK)):
        reason[rows] = why
    quantity, integers = c["quantity"], pd.arrays.IntegerArray
    none = np.isnan(quantity)
    out = pd.DataFrame({
        "id": c["id"], "product_id": integers(product, ~named), "transaction_type": c["transaction_type"],
        "quantity": integers(np.where(none, 0, quantity).astype(np.int32), none), "accepted": accepted,
        "stock_before": integers(before, ~right), "stock_after": integers(after, ~right), "reason": reason,
    })
    balances, new = balances.copy(), named[starts] & ~old
    balances[at[old]] = after[ends[old] - 1]
    fresh = first[new], after[ends[new] - 1], there[new]
    return out, [np.insert(x, at[new], y) for x, y in zip((ids, balances, known), fresh)]


def _fold_bucket(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else (b"", b"", b"")
    stocks = [np.frombuffer(bytes(x), kind) for x, kind in zip(held, ("<i8", "<i8", "?"))]
    for pdf in in_id_order(pdfs, AT_ONCE):
        out, stocks = _fold(pdf, stocks)
        yield out
    state.update(tuple(x.tobytes() for x in stocks))


def ordered_guard(ledger: DataFrame, opening: DataFrame, displacement: int = DISPLACEMENT) -> DataFrame:
    """Streaming guard in id order: verdicts equal those of the batch guard as long as
    no row comes more than ``displacement`` ids late, whatever the files' times and
    however often a file is delivered.  Rows wait until the watermark has passed
    their range of ids (``each_id_once``); ``close_ledger`` ends the waiting.  Then the
    products of a bucket are folded together from their balances.  Needs the RocksDB
    state store (see ``rocksdb_state``)."""
    op = opening.select(F.col("product_id").alias("_opid"), F.coalesce(F.col("opening_stock"), F.lit(0)).cast("bigint").alias("opening_stock"))
    rows = each_id_once(ledger, displacement)
    j = rows.join(op, rows.product_id == op._opid, "left")
    valid = F.coalesce((F.col("quantity") > 0) & F.col("transaction_type").isin(*_SIGN), F.lit(False))
    j = j.select(
        F.pmod(F.hash("product_id"), F.lit(BUCKETS)).alias("bucket"), "id", F.coalesce(F.col("product_id"), F.lit(0).cast("bigint")).alias("product_id"),
        F.col("product_id").isNotNull().alias("named"), "transaction_type", F.col("quantity").cast("double").alias("quantity"), valid.alias("valid"),
        F.coalesce(signed_quantity().cast("bigint"), F.lit(0).cast("bigint")).alias("signed"),
        F.col("_opid").isNotNull().alias("known"), F.coalesce(F.col("opening_stock"), F.lit(0).cast("bigint")).alias("opening_stock"))
    return j.groupBy("bucket").applyInPandasWithState(_fold_bucket, GUARD_OUT, BUCKET_STATE, "append", GroupStateTimeout.NoTimeout)


def closable(spark: SparkSession, ledger: DataFrame, control: str) -> DataFrame:
    """The ledger stream and the folder ``control``, through which it can be closed."""
    columns = ["id", "product_id", "transaction_type", "quantity"]
    rows = ledger.select(*columns)
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(control)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(control))


def close_ledger(spark: SparkSession, control: str) -> None:
    """Say that no more rows will come: the next run judges all that wait."""
    end = spark.createDataFrame([(CLOSING_ID, None, None, None)], "id bigint, product_id bigint, transaction_type string, quantity int")
    end.write.mode("append").parquet(control)


def run_closed(spark: SparkSession, ledger: DataFrame, build, name: str, out_path: str | None = None) -> str:
    """Run ``build(ledger)`` over a bounded ledger to its end: all available files, then
    the closing mark.  Returns the output folder.  What the last files make due is judged
    in the closing mark's batch, not in one of its own before it."""
    out_path, _ = _folders(spark, name, out_path, None)
    control = f"{out_path.rstrip('/')}-control"
    with _set(spark, IDLE_BATCHES, "false"):
        run_to_parquet(spark, build(closable(spark, ledger, control)), name, out_path)
    close_ledger(spark, control)
    return run_to_parquet(spark, build(closable(spark, ledger, control)), name, out_path)


def run_to_parquet(spark: SparkSession, stream: DataFrame, name: str, out_path: str | None = None,
                   checkpoint: str | None = None) -> str:
    """Run an append-mode stream to completion on the available input; a later run
    with the same folders goes on where this one ended."""
    out_path, checkpoint = _folders(spark, name, out_path, checkpoint)
    with rocksdb_state(spark):
        q = (stream.writeStream.outputMode("append").format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


# -- ST3 -------------------------------------------------------------------------

def run_low_stock_alerts(spark: SparkSession, ledger: DataFrame, products: DataFrame,
                         out_path: str | None = None, checkpoint: str | None = None) -> str:
    """ST1 in update mode; each micro-batch's changed stocks joined to the
    products (opening stock + ledger sum against reorder level, Active only).
    Alerts are written per batch id (idempotent on retry)."""
    out_path, checkpoint = _folders(spark, "low-stock-alerts", out_path, checkpoint)
    p = products.select(F.col("id").alias("_pid"), "sku", F.col("name").alias("product_name"),
                        "quantity_in_stock", "reorder_level", "status")

    def write(batch: DataFrame, batch_id: int) -> None:
        j = batch.join(p, batch.product_id == p._pid, "inner")
        balance = F.col("quantity_in_stock") + F.col("stock")
        alerts = j.filter((balance <= F.col("reorder_level")) & (F.col("status") == "Active")).select(
            "product_id", "sku", "product_name", balance.alias("balance"), "reorder_level",
            (F.col("reorder_level") * 2 - balance).alias("recommended_order_qty"),
            F.lit(batch_id).cast("bigint").alias("batch_id"))
        alerts.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    q = (live_stock(ledger).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


# -- ST4 -------------------------------------------------------------------------

def audit_rows(guarded: DataFrame, products: DataFrame) -> DataFrame:
    """Audit rows for accepted, stock-changing rows of a (streaming) guard output."""
    return product_audit_from_guard(guarded, products, changed_at=F.current_timestamp())
