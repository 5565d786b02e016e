"""Tenant audit report over status records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_audit_report(history: DataFrame, ts_col: str = "status_ts") -> DataFrame:
    """Per tenant and status: records and newest time; per tenant and overall
    totals from ``rollup`` with the dead-letter share of each group.

    ``level`` is 0 for (tenant, status) rows, 1 for a tenant's total and 3
    for the grand total (``grouping_id``).
    """
    return history.rollup("tenant_id", "status").agg(
        F.count(F.lit(1)).alias("records"),
        F.max(ts_col).alias("newest_ts"),
        F.avg(F.when(F.col("status") == "dlq", 1.0).otherwise(0.0)).alias("dlq_share"),
        F.grouping_id().cast("int").alias("level"))
