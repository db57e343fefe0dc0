"""R2: the negative-stock guard over an ordered ledger.

Rule, per product in id order, with b the stock and s a row's signed
quantity: the row is accepted and b becomes b + s when b + s >= 0; otherwise
the row is refused and b stays.  Refusing (not clamping) makes the fold
serial within a product, so a hot product needs more than a window:

1. The ledger is cut by row rank (``prefix.ranked``): parts of about equal
   row numbers, sorted by (product, id), right through a hot product.  Only the
   product that a part begins with may go on from the part before; every other
   product in it starts at its opening stock.
2. Each part reports one border row: sum, lowest prefix sum and largest OUT of
   its first product, and the exact final stock of its last one.
3. From these rows the stock at the start of each part is known exactly where
   nothing can be refused on the way, and else lies in an interval: never below
   the clamped walk C (b -> max(b + s, 0)), and above it by less than the largest
   OUT quantity so far.  (b - C only shrinks, or resets below the refused one.)
4. A part that may refuse rows and has a successor becomes a *transfer
   function*: final stock by initial stock over that interval, as merged
   intervals on which the refused rows, and so the shift, are the same.  The
   functions of a product's consecutive parts are composed in a tree of
   ``fan_in``, and the exact start of each part comes back down the tree.
5. Every part is folded once more, batch by batch, from its exact start.

A product that opens below zero first refuses all rows up to one that lifts it
(a grouped ``min``); those rows take no part in the sums.  No quantity is too
large and no product is folded by a single task.  A function of more than
``max_pieces`` intervals is not kept: its part waits until its start is known
exactly, when one interval is enough.  The driver holds one row per part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.columns import signed_quantity
from larder.operators.ledger import with_opening
from larder.operators.prefix import PART, ranked, segments
from larder.sources.schemas import TRANSACTION_TYPES

REFUSED = "negative_stock"
NO_PRODUCT = "no_product"
CHECK = "check"

FAN_IN = 16
MAX_PIECES = 1 << 20


def _first_below(p: np.ndarray, i: int, end: int, threshold: int) -> int:
    """First index j in [i, end) with p[j] < threshold, else end (galloping scan)."""
    step = 64
    while i < end:
        stop = min(end, i + step)
        hits = np.flatnonzero(p[i:stop] < threshold)
        if hits.size:
            return i + int(hits[0])
        i = stop
        step = min(step * 4, 1 << 16)
    return end


def fold_balances(b0: int, s: np.ndarray):
    """Vectorised guard over one product's signed quantities (in id order)
    from balance ``b0``.  Returns (accepted, before, after, final balance)."""
    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    acc = np.ones(n, dtype=bool)
    before = np.empty(n, dtype=np.int64)
    b, i = int(b0), 0
    if b < 0:
        lift = np.flatnonzero(s >= -b)
        j = int(lift[0]) if lift.size else n
        acc[:j] = False
        before[:j] = b
        if j == n:
            return acc, before, before.copy(), b
        before[j] = b
        b += int(s[j])
        i = j + 1
    p = b + np.cumsum(s[i:])
    refused, k, m = 0, 0, len(p)
    while k < m:
        j = _first_below(p, k, m, -refused)
        before[i + k:i + j] = p[k:j] - s[i + k:i + j] + refused
        if j == m:
            break
        before[i + j] = p[j] - s[i + j] + refused
        acc[i + j] = False
        refused -= int(s[i + j])
        k = j + 1
    after = before + np.where(acc, s, 0)
    return acc, before, after, (int(after[-1]) if n else int(b0))


def fold_segments(b0: np.ndarray, s: np.ndarray, judged: np.ndarray, starts: np.ndarray):
    """The guard over a batch of consecutive products, the one at ``starts[k]`` from
    ``b0[k]``.  Rows that are not ``judged`` have s = 0 and leave the stock as it is.

    Products are independent, so the search runs in rounds over all of them at
    once: each round finds, per product, the next row whose prefix sum plus the
    amount refused so far falls below zero.  When few products are still
    searching, each goes on with its own galloping search.  Returns (accepted,
    before, after, final balance of the last product)."""
    n = len(s)
    seg = np.zeros(n, dtype=np.int64)
    seg[starts[1:]] = 1
    seg = np.cumsum(seg)
    ends = np.concatenate((starts[1:], [n]))
    up = np.cumsum(s)
    p = b0[seg] + up - (up[starts] - s[starts])[seg]
    pk = np.where(judged, p, np.iinfo(np.int64).max)
    refused_at = np.zeros(n, dtype=bool)
    r = np.zeros(len(starts), dtype=np.int64)
    pos, active, at = starts.copy(), np.ones(len(starts), dtype=bool), np.arange(n)
    while active.sum() > 8:
        low = judged & (p < -r[seg]) & (at >= pos[seg]) & active[seg]
        first = np.minimum.reduceat(np.where(low, at, n), starts)
        hit = first < n
        active &= hit
        h = first[hit]
        refused_at[h] = True
        r[hit] -= s[h]
        pos[hit] = h + 1
    for k in np.flatnonzero(active).tolist():
        i, end, amount = int(pos[k]), int(ends[k]), int(r[k])
        while (i := _first_below(pk, i, end, -amount)) < end:
            refused_at[i] = True
            amount -= int(s[i])
            i += 1
    amount = np.where(refused_at, -s, 0)
    held = np.cumsum(amount) - amount
    before = p - s + held - held[starts][seg]
    after = before + np.where(refused_at, 0, s)
    return ~refused_at & judged, before, after, int(after[-1])


# -- transfer functions: (starts, ends, stop).  A stock b in [starts[k], starts[k + 1]) becomes
# -- ends[k] + b - starts[k]; the last interval ends before stop.

def merged(starts: np.ndarray, ends: np.ndarray, stop: int):
    shift = ends - starts
    keep = np.concatenate(([True], shift[1:] != shift[:-1]))
    return starts[keep], ends[keep], stop


def compose(f, g):
    """``g`` after ``f``; g's domain holds all values of f."""
    d, y, stop = f
    size = np.diff(np.append(d, stop))
    low = np.searchsorted(g[0], y, "right") - 1
    n = np.searchsorted(g[0], y + size - 1, "right") - low
    j = np.repeat(np.arange(len(d)), n)
    k = low[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
    cut = np.maximum(g[0][k], y[j])
    return merged(d[j] + cut - y[j], g[1][k] + cut - g[0][k], stop)


def value(f, b: int) -> int:
    k = int(np.searchsorted(f[0], b, "right")) - 1
    if k < 0 or b >= f[2]:
        raise ValueError(f"stock {b} lies outside the bounds of its part")
    return int(f[1][k]) + b - int(f[0][k])


def transfer(s: np.ndarray, low: int, high: int, max_pieces: int = MAX_PIECES):
    """Transfer function of a product's consecutive rows for stocks from ``low`` to
    ``high`` (both >= 0, or equal); None beyond ``max_pieces`` intervals.

    Rows at which even the lowest value cannot be refused are skipped by a
    galloping search over the prefix sums.  At any other row the intervals below
    its quantity stay, those above shift, and one that holds the quantity is
    split.  This runs over a few hundred intervals at a time, which are then
    composed with what came before."""
    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    cum = np.cumsum(s)
    f = (np.array([low], dtype=np.int64), np.array([low], dtype=np.int64), high + 1)
    i, base = 0, 0
    while i < n:
        image_stop = int((f[1] + np.diff(np.append(f[0], f[2]))).max())
        start = int(f[1].min())
        d, y, stop = np.array([start], dtype=np.int64), np.array([start - base], dtype=np.int64), image_stop
        steps = 0
        while len(d) < 512 and steps < 4096:
            j = _first_below(cum, i, n, -int(y.min()))
            if j == n:
                i = n
                break
            limit = -int(cum[j])
            size = np.diff(np.append(d, stop))
            split = np.flatnonzero((y < limit) & (y + size > limit))
            if len(split):
                d, y = np.insert(d, split + 1, d[split] + limit - y[split]), np.insert(y, split + 1, limit)
            y = np.where(y < limit, y - s[j], y)
            i, steps = j + 1, steps + 1
            if i == n:
                break
        base = int(cum[i - 1])
        f = compose(f, merged(d, y + base, stop))
        if len(f[0]) > max_pieces:
            return None
    return f


# -- parts ---------------------------------------------------------------------------

_BORDER = ("part int, head bigint, open bigint, total bigint, lowest bigint, largest bigint, gain bigint, opens boolean, "
           "whole boolean, tail bigint, tail_end bigint")
_FUNCTION = "chain bigint, seq bigint, part int, starts binary, ends binary, stop bigint"


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


class _Run:
    """What a part's border row says of one product: its judged rows so far."""

    def __init__(self, product, opening: int, keep: bool):
        self.product, self.opening, self.rows = product, opening, [] if keep else None
        self.total, self.lowest, self.largest, self.gain, self.opens = 0, None, 0, 0, False

    def add(self, s: np.ndarray, judged: np.ndarray, pre: bool) -> None:
        self.opens |= pre
        s = s[judged]
        if not len(s):
            return
        up = self.total + np.cumsum(s)
        low = int(up.min())
        self.lowest = low if self.lowest is None else min(self.lowest, low)
        self.largest = max(self.largest, int(-s.min()))
        self.gain += int(s[s > 0].sum())
        self.total = int(up[-1])
        if self.rows is not None:
            self.rows.append(s)

    def end(self) -> int:
        return fold_balances(self.opening, np.concatenate(self.rows))[3] if self.rows else self.opening


def _columns(b: pa.RecordBatch, first: int):
    """Signed quantity, judged and refused-while-negative flags from the columns at ``first``: _s, _why."""
    s = b.column(first).to_numpy(zero_copy_only=False)
    why = b.column(first + 1)
    judged = why.is_null().to_numpy(zero_copy_only=False)
    pre = np.zeros(len(s), dtype=bool) if judged.all() else (np.array(why.to_pylist(), dtype=object) == REFUSED)
    return s, judged, pre


def _borders(cut: DataFrame) -> list:
    def run(batches):
        part, head, current = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, opening = b.column(1), b.column(2)
            s, judged, pre = _columns(b, 3)
            starts = segments(keys).tolist() + [b.num_rows]
            if part is None:
                part = b.column(0)[0].as_py()
                current = head = _Run(keys[0].as_py(), opening[0].as_py(), False)
            for k in sorted({0, len(starts) - 2}):  # products that begin and end inside the batch need no border
                i, j = starts[k], starts[k + 1]
                if keys[i].as_py() != current.product:
                    current = _Run(keys[i].as_py(), opening[i].as_py(), True)
                current.add(s[i:j], judged[i:j], bool(pre[i:j].any()))
        if part is not None:
            whole = current is head
            yield pa.RecordBatch.from_pylist([{
                "part": part, "head": head.product, "open": head.opening, "total": head.total, "lowest": head.lowest, "largest": head.largest,
                "gain": head.gain, "opens": head.opens, "whole": whole, "tail": current.product, "tail_end": None if whole else current.end()}],
                schema=_arrow(_BORDER))

    return sorted(cut.select(PART, "product_id", "_open", "_s", "_why").mapInArrow(run, _BORDER).collect(), key=lambda r: r["part"])


def plan_parts(borders: list, ends: dict[int, int]) -> tuple[dict, list]:
    """(exact, todo): the start stock of each part as far as it is known, given the
    exact final stocks ``ends`` found so far; and the parts whose function is
    needed, as [chain, seq, part, low, high, shift].  A chain begins where the
    stock is exact; ``shift`` is what the parts without refusals add on the way to
    the next part of the chain."""
    exact, todo, links = {}, [], []
    key, seen, b, low, high = None, False, None, 0, 0
    for k, r in enumerate(borders):
        if not seen or r["head"] != key or r["opens"]:
            b = r["open"]
        if b is not None:
            exact[r["part"]], low, high, links = b, b, b, []
        key, seen = r["tail"], True
        if not r["whole"]:
            b = r["tail_end"]
        elif r["part"] in ends:
            b = ends[r["part"]]
        elif r["lowest"] is None or low + r["lowest"] >= 0:  # nothing can be refused
            b = None if b is None else b + r["total"]
            low, high = low + r["total"], high + r["total"]
            if links:
                links[-1][5] += r["total"]
        elif k + 1 < len(borders) and borders[k + 1]["head"] == key:
            links.append([links[0][0] if links else k, len(links), r["part"], low, high, 0])
            todo.append(links[-1])
            end = low + r["total"] - min(0, low + r["lowest"])
            b, low, high = None, end, min(high + r["gain"], end + max(high - low, r["largest"] - 1))
    return exact, todo


def _functions(cut: DataFrame, todo: list, max_pieces: int) -> DataFrame:
    """Transfer functions of the parts in ``todo``, each of one product alone: one row per part."""
    wanted = {t[2]: t for t in todo}

    def run(batches):
        part, rows = None, []
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                s, judged, _ = _columns(b, 1)
                rows.append(s[judged])
        if part is not None:
            chain, seq, _, low, high, shift = wanted[part]
            s = np.concatenate(rows)
            f = (np.array([low]), np.array([fold_balances(low, s)[3]]), low + 1) if low == high else transfer(s, low, high, max_pieces)
            yield _function(chain, seq, part, f and (f[0], f[1] + shift, f[2]))

    return cut.where(F.col(PART).isin(list(wanted))).select(PART, "_s", "_why").mapInArrow(run, _FUNCTION).checkpoint()


def _function(chain, seq, part, f) -> pa.RecordBatch:
    row = {"chain": chain, "seq": seq, "part": part, "starts": None, "ends": None, "stop": None}
    if f is not None:
        row |= {"starts": f[0].astype("<i8").tobytes(), "ends": f[1].astype("<i8").tobytes(), "stop": int(f[2])}
    return pa.RecordBatch.from_pylist([row], schema=_arrow(_FUNCTION))


def _read(row: dict):
    return None if row["starts"] is None else (np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["ends"], "<i8"), row["stop"])


def _compose_group(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["seq"])
    f = _read(rows[0])
    for r in rows[1:]:
        g = _read(r)
        f = None if f is None or g is None else compose(f, g)
        if f is not None and len(f[0]) > 4 * MAX_PIECES:
            f = None
    return pa.Table.from_batches([_function(rows[0]["chain"], rows[0]["group"], None, f)])


_STEP = "chain bigint, seq bigint, part int, start bigint, end bigint"


def _evaluate(rows: list[dict], b: int | None) -> pa.Table:
    """Start and end of each function of a group whose first starts at ``b``."""
    out = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        f = _read(r)
        end = None if b is None or f is None else value(f, b)
        out.append({"chain": r["chain"], "seq": r["seq"], "part": r["part"], "start": b, "end": end})
        b = end
    return pa.Table.from_pylist(out, schema=_arrow(_STEP))


def _resolve(functions: DataFrame, todo: list, fan_in: int) -> dict[int, int]:
    """Exact final stock by part, wherever the functions tell it."""
    first = {t[0]: t[3] for t in todo if t[1] == 0}
    shift = {t[2]: t[5] for t in todo}
    longest = 1 + max(t[1] for t in todo)
    group = F.floor(F.col("seq") / fan_in).cast("bigint")
    levels = [functions]
    while longest > fan_in:
        up = levels[-1].withColumn("group", group).groupBy("chain", "group").applyInArrow(_compose_group, _FUNCTION).checkpoint()
        levels.append(up)
        longest = -(-longest // fan_in)
    steps = levels[-1].groupBy("chain").applyInArrow(lambda t: _evaluate(t.to_pylist(), first[t["chain"][0].as_py()]), _STEP)
    for level in reversed(levels[:-1]):
        above = steps.select(F.col("chain"), F.col("seq").alias("group"), F.col("start").alias("b"))
        steps = level.withColumn("group", group).join(above, ["chain", "group"]).groupBy("chain", "group").applyInArrow(
            lambda t: _evaluate(t.to_pylist(), t["b"][0].as_py()), _STEP)
    # one row per part; the shift belongs to the parts after this one
    return {r["part"]: r["end"] - shift[r["part"]] for r in steps.where("end IS NOT NULL").select("part", "end").collect()}


def guard_ledger(opening: DataFrame, ledger: DataFrame, partitions: int | None = None, fan_in: int = FAN_IN,
                 max_pieces: int = MAX_PIECES) -> DataFrame:
    """Judge every ledger row against the running stock.

    ``opening``: (product_id, opening_stock), one row for each product.  Returns
    the ledger's columns plus accepted, stock_before, stock_after (bigint) and
    reason: null, 'negative_stock', or before any judgement 'check' (quantity
    missing or not above 0, unknown type) and 'no_product' (no such product);
    these have no stock.  ``partitions`` fixes the number of parts (default: the
    session's shuffle partitions).  The ranked rows are checkpointed (an eager job).
    """
    cols = ledger.columns
    # rows that a CHECK, NOT NULL or the foreign key refuses are not judged
    valid = F.coalesce((F.col("quantity") > 0) & F.col("transaction_type").isin(*TRANSACTION_TYPES), F.lit(False))
    t = with_opening(ledger, opening).withColumn("_s", F.coalesce(signed_quantity().cast("bigint"), F.lit(0)))
    t = t.withColumn("_why", F.when(~valid, CHECK).when(~F.col("_known"), NO_PRODUCT))
    if not opening.where("opening_stock < 0").isEmpty():
        lift = (t.where(F.col("_why").isNull() & (F.col("_open") < 0) & (F.col("_s") >= -F.col("_open")))
                .groupBy(F.col("product_id").alias("_lifted")).agg(F.min("id").alias("_lift")))
        t = t.join(lift, t.product_id == lift._lifted, "left")
        waits = F.col("_why").isNull() & (F.col("_open") < 0) & (F.col("_lift").isNull() | (F.col("id") < F.col("_lift")))
        t = t.withColumn("_why", F.when(waits, REFUSED).otherwise(F.col("_why")))
    t = t.select(*cols, "_open", "_why", F.when(F.col("_why").isNull(), F.col("_s")).otherwise(F.lit(0)).alias("_s"))
    cut = ranked(t, "product_id", "id", partitions)

    borders, ends = _borders(cut), {}
    while True:
        exact, todo = plan_parts(borders, ends)
        if not todo:
            break
        ends |= _resolve(_functions(cut, todo, max_pieces), todo, fan_in)

    at = {c: i for i, c in enumerate(cut.columns)}
    names = [*cols, "accepted", "stock_before", "stock_after", "reason"]

    def run(batches):
        b0, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, opens = b.column(at["product_id"]), b.column(at["_open"]).to_numpy(zero_copy_only=False)
            s, why = b.column(at["_s"]).to_numpy(zero_copy_only=False), b.column(at["_why"])
            judged = why.is_null().to_numpy(zero_copy_only=False)
            starts = segments(keys)
            stock = opens[starts].astype(np.int64)
            if b0 is None:
                stock[0] = exact[b.column(at[PART])[0].as_py()]
            elif keys[0].as_py() == last:
                stock[0] = b0
            accepted, before, after, b0 = fold_segments(stock, s, judged, starts)
            last = keys[b.num_rows - 1].as_py()
            reason = np.array(why.to_pylist(), dtype=object)
            reason[judged & ~accepted] = REFUSED
            blank = (reason == CHECK) | (reason == NO_PRODUCT)
            yield pa.RecordBatch.from_arrays([
                *[b.column(at[c]) for c in cols], pa.array(accepted), pa.array(before, mask=blank), pa.array(after, mask=blank),
                pa.array(reason, pa.string())], names=names)

    schema = T.StructType(ledger.schema.fields + [
        T.StructField("accepted", T.BooleanType()), T.StructField("stock_before", T.LongType()),
        T.StructField("stock_after", T.LongType()), T.StructField("reason", T.StringType())])
    return cut.mapInArrow(run, schema)


def guard_reference(opening: pd.DataFrame, ledger: pd.DataFrame) -> pd.DataFrame:
    """Plain row-by-row fold in pandas, for tests on small fixtures only."""
    open_map = dict(zip(opening["product_id"], opening["opening_stock"]))
    bal: dict = {}
    rows = []
    sign = {"IN": 1, "OUT": -1, "ADJUSTMENT": 1}
    for r in ledger.sort_values("id").itertuples(index=False):
        b = bal.get(r.product_id, open_map.get(r.product_id, 0))
        s = sign.get(r.transaction_type, 0) * r.quantity
        ok = b + s >= 0
        after = b + s if ok else b
        bal[r.product_id] = after
        rows.append((r.id, r.product_id, ok, b, after))
    return pd.DataFrame(rows, columns=["id", "product_id", "accepted", "stock_before", "stock_after"])
