"""Column-expression helpers (all built-in Spark functions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signed_quantity(type_col="transaction_type", qty_col="quantity") -> Column:
    """Stock effect of a ledger row: IN adds, OUT subtracts, ADJUSTMENT adds."""
    t, q = col_or_name(type_col), col_or_name(qty_col)
    return (
        F.when(t == "IN", q)
        .when(t == "OUT", -q)
        .when(t == "ADJUSTMENT", q)
        .otherwise(F.lit(0))
    )


def fractional_days(later, earlier) -> Column:
    """Exact day difference with fraction (``datediff`` would truncate)."""
    return (F.unix_micros(col_or_name(later)) - F.unix_micros(col_or_name(earlier))) / F.lit(
        MICROS_PER_DAY
    )


def audit_json(**fields) -> Column:
    """JSON object text keeping null fields, like the audit triggers write."""
    parts = [col_or_name(v).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def normalize_sku(c) -> Column:
    return F.upper(F.trim(col_or_name(c)))


def order_reference(order_id) -> Column:
    from larder.sources.schemas import ORDER_REFERENCE_PREFIX

    return F.concat(F.lit(ORDER_REFERENCE_PREFIX), col_or_name(order_id).cast("string"))


def as_bigint(c) -> Column:
    return col_or_name(c).cast("bigint")


def as_double(c) -> Column:
    return col_or_name(c).cast("double")


def to_ntz(c) -> Column:
    """Timestamps leave the library as wall-clock UTC (TIMESTAMP_NTZ)."""
    return col_or_name(c).cast("timestamp_ntz")


def ntz_outputs(df):
    """Cast every TIMESTAMP column of a result to TIMESTAMP_NTZ."""
    from pyspark.sql.types import TimestampType

    cols = [
        to_ntz(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
