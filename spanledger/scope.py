"""Tenant scope that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; an unset tenant sees nothing."""
    if tenant is None:
        return df.where(F.lit(False))
    return df.where(F.col(column) == F.lit(tenant))


def split_foreign_writes(
    df: DataFrame, tenant: str | None, column: str = "tenant_id"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of a write made on behalf of ``tenant``."""
    own: Column = F.lit(False) if tenant is None else F.col(column).eqNullSafe(F.lit(tenant))
    return df.where(own), df.where(~own)


def writable_by(session_tenant: Column, row_tenant: Column) -> Column:
    """Row-level form of the same rule for tables that carry both ids."""
    return F.coalesce(session_tenant == row_tenant, F.lit(False))
