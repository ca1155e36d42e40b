"""Console operations over tables: scope, pages, filters, counts, statistics and immutable rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities in the order in which alerts are shown.
SEVERITIES = ("critical", "warning", "info")


def valid_scope(tenant: str | None, owner: str | None) -> bool:
    return bool(tenant and tenant.strip() and owner and owner.strip())


def fallback_scope(user: str) -> tuple[str, str]:
    return user, user


def scoped(df: DataFrame, tenant: str, owner: str, tenant_col: str = "tenant_id", owner_col: str = "owner_user_id") -> DataFrame:
    """Rows of one tenant and owner. A blank scope is an error, never all rows."""
    if not valid_scope(tenant, owner):
        raise ValueError("a scope needs a tenant and an owner")
    return df.where((F.col(tenant_col) == tenant) & (F.col(owner_col) == owner))


def live(df: DataFrame, flag: str = "deleted_flag") -> DataFrame:
    return df.where(F.col(flag) == 0)


def clamp_page(page: int, size: int) -> tuple[int, int]:
    """Page from 1; size 20 if not positive, 100 at most."""
    return max(1, page), 20 if size <= 0 else min(size, 100)


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    page, size = clamp_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def matching(df: DataFrame, equal: dict[str, object] | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Optional predicates: those that are None or '' are not applied; time bounds are inclusive."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v not in (None, "")]
    if since and since[1] is not None:
        tests.append(F.col(since[0]) >= F.lit(since[1]))
    if until and until[1] is not None:
        tests.append(F.col(until[0]) <= F.lit(until[1]))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def point(df: DataFrame, **equal: object) -> DataFrame:
    """Rows by key, for example one alert or session by its id."""
    return matching(df, equal)


def first_by(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row, by an order that leaves no choice."""
    return df.orderBy(*order).limit(1)


def newest_first(df: DataFrame, time: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties])


def oldest_first(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """Rows in the order in which they came, as a history is replayed."""
    return df.orderBy(F.col(time).asc(), *[F.col(t).asc() for t in ties])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "warning", 2).when(severity == "info", 3)


def active_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = "active", time: str = "alert_time") -> DataFrame:
    """Alerts by severity, unknown ones first, then newest; severity None, '' or 'all' means every one."""
    rows = alerts if status in (None, "", "all") else alerts.where(F.col("status") == status)
    if severity in (None, "", "all"):
        return rows.orderBy(severity_rank(F.col("severity")).asc_nulls_first(), F.col(time).desc())
    return rows.where(F.col("severity") == severity).orderBy(F.col(time).desc())


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Active alerts by severity in one pass; total is the sum of the three, other severities are left out."""
    n = [F.coalesce(F.sum(F.when((F.col("status") == "active") & (F.col("severity") == s), 1)), F.lit(0)).cast("long").alias(s) for s in SEVERITIES]
    return alerts.agg(*n).withColumn("total", F.col("critical") + F.col("warning") + F.col("info"))


def outcome_stats(df: DataFrame, key: str, result: str = "result") -> DataFrame:
    """(key, total, success, failure), largest first."""
    n = lambda v: F.sum(F.when(F.col(result) == v, 1).otherwise(0)).cast("long")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), n("SUCCESS").alias("success"), n("FAILURE").alias("failure")).orderBy(F.desc("total"), F.asc(key))


def mean_stats(df: DataFrame, key: Column, value: str, name: str = "key") -> DataFrame:
    """(key, total, mean) of a grouping, largest first."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("total"), F.avg(value).alias("mean")).orderBy(F.desc("total"), F.asc(name))


def mean_by_day(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.avg(value).alias("mean")).orderBy("day")


def with_document_counts(bases: DataFrame, documents: DataFrame, keys: Sequence[str], live_documents: Column, count: str = "document_count") -> DataFrame:
    """bases with the number of their live documents, 0 where there are none.

    The condition on documents is applied below the left join, and documents are counted before it, so what is joined has a row for each base.
    """
    counted = documents.where(live_documents).groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return bases.join(counted, list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def distinct_scopes(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def scope_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose path begins with prefix, as written: % and _ are no wildcards."""
    return df.where(F.col(column).startswith(prefix))


def recent(df: DataFrame, n: int, time: str = "created_at", tie: str = "memory_id") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def count_matching(df: DataFrame, *tests: Column, name: str = "n") -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, tests) if tests else F.lit(True)).agg(F.count(F.lit(1)).alias(name))


# Tables are immutable: a statement that changes rows returns the table that follows.


def inserted(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """table and rows; columns that rows lack, or have null, get their default."""
    for c, v in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), v) if c in rows.columns else v)
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def updated(table: DataFrame, where: Column, **values: object) -> DataFrame:
    """table with new values in the rows where the condition is true; null conditions change nothing."""
    hit = F.coalesce(where, F.lit(False))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return table.withColumns({c: F.when(hit, lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def soft_deleted(table: DataFrame, where: Column, flag: str = "deleted_flag") -> DataFrame:
    return updated(table, where & (F.col(flag) == 0), **{flag: 1})


def expired(table: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """table without rows whose time is over; rows without one stay."""
    return deleted(table, F.col(column) < now)


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key over both; among equal order rows come before the table's."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(*table.columns)


# What a memory row has where nothing is given.
MEMORY_DEFAULTS = {"type": "FACT", "scope": "/", "importance": 0.5, "status": 1}


def insert_memory(table: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    given = {c: F.lit(v) for c, v in MEMORY_DEFAULTS.items()}
    text = {c: F.lit("") for c, t in rows.dtypes if t == "string" and c not in given}
    return inserted(table, rows, given | text | {"created_at": now})


def create_alert(rows: DataFrame) -> DataFrame:
    """Alerts as they are stored: a missing id is made, the status is active whatever was given."""
    made = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    own = F.coalesce(F.col("alert_id"), made) if "alert_id" in rows.columns else made
    return rows.withColumn("alert_id", own).withColumn("status", F.lit("active"))


def branch_and_intent(has_retrieval: Column, tool_calls: Column) -> tuple[Column, Column]:
    """How an answer came about, and the intent that follows from it."""
    branch = F.when(has_retrieval, "RAG").when(tool_calls > 0, "TOOL_CALL").otherwise("DIRECT_ANSWER")
    return branch, intent(branch)


def intent(branch: Column) -> Column:
    return F.when(branch == "RAG", "knowledge_query").when(branch == "TOOL_CALL", "tool_invocation").when(branch == "REJECT", "rejection").otherwise("general_chat")


def admin_tenant(asked: str | None, own: str) -> str:
    """A blank tenant in an admin query is the caller's own, never all."""
    return asked if asked and asked.strip() else own


def parsed_sources(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON list column as an array; null or broken JSON gives an empty array."""
    empty = F.array().cast(schema)
    return df.withColumn(column, F.coalesce(F.from_json(column, schema, {"mode": "PERMISSIVE"}), empty))
