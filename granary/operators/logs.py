"""Logs: keyword filter, topics, limits and the selectors that are pushed to a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The selector of each log topic; any other topic selects every job.
TOPICS = {"system-metrics": 'job="varlogs"', "application-logs": 'level=~"ERROR|WARN"', "database-slow-query": 'level="WARN"', "system-events": 'job="varlogs"'}
OTHER_TOPIC = 'job=~".*"'


def has_keywords(query: str | Column, *columns: Column, metadata: Column | None = None) -> Column:
    """Whether every word of query occurs in the columns and metadata values, without case; a blank query holds for all."""
    query = F.lit(query) if isinstance(query, str) or query is None else query
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    if metadata is not None:
        parts.append(F.coalesce(F.array_join(F.map_values(metadata), ", "), F.lit("")))
    text = F.lower(F.concat_ws(" ", *parts))
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(text, w))


def filtered(logs: DataFrame, query: str | None) -> DataFrame:
    return logs.where(has_keywords(query, F.col("message"), F.col("service_name"), F.col("level"), F.col("source"), metadata=F.col("metadata")))


def topic_selector(topic: str, query: str | None = None) -> str:
    """The store's selector of a topic, and a line filter for a query."""
    out = "{" + TOPICS.get(topic, OTHER_TOPIC) + "}"
    return out + ' |= "' + query.replace('"', '\\"') + '"' if query and query.strip() else out


def topic_logs(logs: DataFrame, topic: str, query: str | None = None, limit: int = 10) -> DataFrame:
    """Rows of a known topic by keywords, 10 where the limit is not positive; none of an unknown topic. The newest come first."""
    rows = logs.where(F.col("topic") == topic) if topic in TOPICS else logs.where(F.lit(False))
    return filtered(rows, query).orderBy(F.desc("timestamp"), "message").limit(limit if limit > 0 else 10)


def store_limit(limit: int) -> int:
    return limit if limit > 0 else 100
