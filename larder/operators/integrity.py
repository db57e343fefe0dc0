"""Data-integrity jobs (C1-C5) driven by the constraint metadata in
``sources.schemas``.

Every report is a set of rows naming the table, the rule and the row, built
with one scan per table (C1), a grouped count (C2, C5) or anti/semi joins
(C3, C4).  No job collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import checkpoint_dir
from larder.sources.schemas import CHECKS, FOREIGN_KEYS, UNIQUE, not_null_columns


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """CHECK and NOT NULL violations (table_name, rule, row_id).

    One pass per table: an array of the names of the rules a row breaks,
    compacted and exploded.  A CHECK fails only when its predicate is false
    (null passes); NOT NULL rules are named ``<column>_not_null``.
    """
    parts = []
    for table, df in tables.items():
        rules = []
        for rule, predicate in CHECKS.get(table, []):
            rules.append((rule, F.coalesce(~F.expr(predicate), F.lit(False))))
        for c in not_null_columns(table):
            if c in df.columns:
                rules.append((f"{c}_not_null", F.col(c).isNull()))
        if not rules:
            continue
        # violations are rare: a codegen'd filter on "breaks any rule" first,
        # the per-row array of rule names only for the rows that remain
        any_broken = reduce(lambda a, b: a | b, [cond for _, cond in rules])
        names = [F.when(cond, F.lit(rule)) for rule, cond in rules]
        broken = df.filter(any_broken).select(F.col("id").alias("row_id"),
                                              F.array_compact(F.array(*names)).alias("_rules"))
        parts.append(broken.select(F.lit(table).alias("table_name"), F.explode("_rules").alias("rule"), "row_id"))
    return _union(parts)


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Values of UNIQUE columns held by more than one row
    (table_name, column_name, value, n, first_id).  Nulls are not compared."""
    parts = []
    for table, df in tables.items():
        for c in UNIQUE.get(table, []):
            g = (df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value"))
                 .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("id").alias("first_id"))
                 .filter(F.col("n") > 1))
            parts.append(g.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                                  F.col("value").cast("string").alias("value"), "n", "first_id"))
    return _union(parts)


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose non-null foreign key names no parent row
    (table_name, column_name, row_id, missing_key)."""
    parts = []
    for fk in FOREIGN_KEYS:
        if fk.table not in tables or fk.parent not in tables:
            continue
        child = tables[fk.table].filter(F.col(fk.column).isNotNull())
        parent = tables[fk.parent].select(F.col("id").alias("_parent_id"))
        dangling = child.join(parent, child[fk.column] == parent._parent_id, "left_anti")
        parts.append(dangling.select(
            F.lit(fk.table).alias("table_name"), F.lit(fk.column).alias("column_name"),
            F.col("id").alias("row_id"), F.col(fk.column).cast("bigint").alias("missing_key")))
    return _union(parts)


def _delete_order(tables: list[str]) -> list[str]:
    """Order the deletes of a batch so that a parent's RESTRICT check comes
    after every delete that can remove its referencing rows: the child's own
    delete, and deletes that cascade into the child."""
    before: dict[str, set] = {t: set() for t in tables}
    for fk in FOREIGN_KEYS:
        if fk.on_delete != "restrict" or fk.parent not in before:
            continue
        sources = {fk.table} | {c.parent for c in FOREIGN_KEYS if c.table == fk.table and c.on_delete == "cascade"}
        before[fk.parent] |= {x for x in sources if x in before and x != fk.parent}
    order: list[str] = []
    while len(order) < len(tables):
        ready = [t for t in tables if t not in order and before[t] <= set(order)]
        order.extend(ready or [t for t in tables if t not in order])
    return order


def delete_impact(tables: dict[str, DataFrame], keys: dict[str, DataFrame], chained: bool = False) -> DataFrame:
    """C4: what deleting the given keys would do (table_name, row_id, effect).

    ``keys[table]`` holds an ``id`` column.  A key row is ``restricted`` when a
    RESTRICT child references it, else ``deleted``; children of deleted rows
    are ``set_null`` or ``cascaded`` by their ON DELETE action.  By default
    each table's delete is judged against the tables as given.  With
    ``chained`` the deletes run children-first and a later delete no longer
    sees rows that earlier deletes or their cascades removed (e.g. deleting an
    order and then the product its only item referenced is allowed).

    Per table one grouped verdict: the keys, the table's ids and the references
    of all its RESTRICT children are stacked with a tag and grouped by id, so
    they share one exchange, which partial aggregation keeps at one row per id
    and task however often a parent is referenced.  The verdicts are materialised;
    the children that follow a deleted row are stacked too and take one semi join.
    """
    parts, removed = [], {}

    def remaining(table: str) -> DataFrame:
        df = tables[table]
        if not chained or table not in removed:
            return df
        gone = removed[table].select(F.col("id").alias("_gone"))
        return df.join(gone, df.id == gone._gone, "left_anti")

    def mark_removed(table: str, ids: DataFrame) -> None:
        removed[table] = ids if table not in removed else removed[table].unionByName(ids)

    def tagged(df: DataFrame, column: str, tag: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("_ref"), F.lit(tag).alias("_tag"))

    for table in (_delete_order(list(keys)) if chained else list(keys)):
        checkpoint_dir(tables[table].sparkSession)
        edges = [fk for fk in FOREIGN_KEYS if fk.parent == table and fk.table in tables]
        stacked = _union([tagged(keys[table], "id", "key"), tagged(remaining(table), "id", "row"),
                          *[tagged(remaining(fk.table), fk.column, "restrict") for fk in edges if fk.on_delete == "restrict"]])
        has = {t: F.coalesce(F.bool_or(F.col("_tag") == t), F.lit(False)) for t in ("key", "row", "restrict")}
        verdict = (stacked.groupBy("_ref").agg(*[c.alias(f"_{t}") for t, c in has.items()])
                   .where("_key AND _row").select("_ref", "_restrict").checkpoint())
        parts.append(verdict.select(F.lit(table).alias("table_name"), F.col("_ref").alias("row_id"),
                                    F.when(F.col("_restrict"), "restricted").otherwise("deleted").alias("effect")))
        deleted = verdict.where("NOT _restrict").select("_ref")
        mark_removed(table, deleted.select(F.col("_ref").alias("id")))
        following = [fk for fk in edges if fk.on_delete != "restrict"]
        if following:
            rows = _union([remaining(fk.table).where(F.col(fk.column).isNotNull()).select(
                F.col(fk.column).cast("bigint").alias("_ref"), F.lit(fk.table).alias("table_name"), F.col("id").alias("row_id"),
                F.lit("set_null" if fk.on_delete == "set_null" else "cascaded").alias("effect")) for fk in following])
            hit = rows.join(deleted, "_ref", "left_semi").drop("_ref")
            if chained:
                hit = hit.checkpoint()
            parts.append(hit)
            for fk in following:
                if fk.on_delete == "cascade":
                    mark_removed(fk.table, hit.where(F.col("table_name") == fk.table).select(F.col("row_id").alias("id")))
    return _union(parts)


def fd_violations(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """Left-hand values that map to more than one right-hand value, with the
    number of distinct right-hand values.  Two-level grouping: the inner
    group by (lhs, rhs) is partially aggregated, so no lhs value is ever
    gathered whole."""
    pairs = df.groupBy(*lhs, *rhs).agg(F.count(F.lit(1)).alias("_rows"))
    return pairs.groupBy(*lhs).agg(F.count(F.lit(1)).alias("distinct_rhs")).filter(F.col("distinct_rhs") > 1)


def fd_check(checks: list[tuple[str, DataFrame, list[str], list[str]]]) -> DataFrame:
    """For each (table_name, df, lhs, rhs), the number of lhs values that
    break the dependency lhs -> rhs (0 when it holds)."""
    parts = []
    for table, df, lhs, rhs in checks:
        v = fd_violations(df, lhs, rhs).agg(F.count(F.lit(1)).cast("bigint").alias("violations"))
        parts.append(v.select(F.lit(table).alias("table_name"), F.lit(",".join(lhs)).alias("lhs"),
                              F.lit(",".join(rhs)).alias("rhs"), "violations"))
    return _union(parts)
