"""Replies of log and metric stores as rows, sources that fetch them, and fixed sample data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import iso_of_nanos
from ..operators.logs import store_limit, topic_selector

_LOKI = "struct<status: string, data: struct<result: array<struct<stream: map<string, string>, values: array<array<string>>>>>>"
_ALERTS = "struct<status: string, data: struct<alerts: array<struct<labels: map<string, string>, annotations: map<string, string>, state: string, activeAt: string>>>>"
_METRICS = "struct<status: string, data: struct<resultType: string, result: array<struct<metric: map<string, string>, value: array<string>, values: array<array<string>>>>>>"


def reply_status(body: Column, schema: str = _LOKI) -> Column:
    """The status of a reply; error for broken JSON."""
    parsed = F.from_json(body, schema)
    return F.when(parsed.isNull() | (parsed["status"].isNull() & parsed["data"].isNull()), "error").otherwise(F.coalesce(parsed["status"], F.lit("unknown")))


def loki_rows(replies: DataFrame, body: str = "body") -> DataFrame:
    """A row a line: timestamp, level, source, service_name, message, metadata; labels that are missing get their defaults."""
    rows = replies.select(F.explode(F.from_json(body, _LOKI)["data"]["result"]).alias("r")).select("r.stream", F.explode("r.values").alias("v"))
    label = lambda k, d: F.coalesce(F.try_element_at("stream", F.lit(k)), F.lit(d))
    at = F.coalesce(F.get("v", F.lit(0)), F.lit(""))
    return rows.select(iso_of_nanos(at).alias("timestamp"), label("level", "INFO").alias("level"), label("container", "unknown").alias("source"), label("service", "unknown").alias("service_name"), F.coalesce(F.get("v", F.lit(1)), F.lit("")).alias("message"), F.coalesce("stream", F.expr("cast(map() as map<string, string>)")).alias("metadata"))


def prometheus_alerts(replies: DataFrame, body: str = "body") -> DataFrame:
    """A row an alert, with labels as columns; unknown where one is missing."""
    rows = replies.select(F.explode(F.from_json(body, _ALERTS)["data"]["alerts"]).alias("a"))
    label = lambda k: F.coalesce(F.try_element_at("a.labels", F.lit(k)), F.lit("unknown"))
    return rows.select(label("alertname").alias("alert_name"), F.coalesce("a.state", F.lit("unknown")).alias("state"), label("severity").alias("severity"), label("service").alias("service_name"), label("instance").alias("instance"), F.coalesce(F.try_element_at("a.annotations", F.lit("description")), F.lit("")).alias("description"), F.coalesce("a.activeAt", F.lit("")).alias("fired_at"), F.coalesce("a.labels", F.expr("cast(map() as map<string, string>)")).alias("labels"))


def prometheus_points(replies: DataFrame, body: str = "body") -> DataFrame:
    """A row a point: metric, timestamp and value as text; a vector has one point a metric, a matrix its series."""
    rows = replies.select(F.explode(F.from_json(body, _METRICS)["data"]["result"]).alias("r"))
    points = F.when(F.size("r.value") == 2, F.array("r.value")).otherwise(F.coalesce("r.values", F.array().cast("array<array<string>>")))
    return rows.select(F.col("r.metric").alias("metric"), F.explode_outer(points).alias("p")).select("metric", F.get("p", F.lit(0)).alias("timestamp"), F.get("p", F.lit(1)).alias("value"))


class _Replies(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        with urlopen(partition.value, timeout=30) as r:  # noqa: S310  the address is the caller's
            yield (partition.value, r.read().decode())


class HttpReplies(DataSource):
    """Replies of HTTP addresses (option urls, one a line), one task each: (url, body)."""

    @classmethod
    def name(cls) -> str:
        return "http_replies"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Replies([u for u in self.options.get("urls", "").split("\n") if u])


def loki_url(base: str, topic: str, query: str | None, start_ns: int, end_ns: int, limit: int = 0) -> str:
    """The address of a range query: newest first, the query pushed down as a line filter."""
    from urllib.parse import urlencode

    return f"{base}/loki/api/v1/query_range?" + urlencode({"query": topic_selector(topic, query), "start": start_ns, "end": end_ns, "limit": store_limit(limit), "direction": "backward"})


def prometheus_url(base: str, kind: str, **parameters: object) -> str:
    """The address of alerts, query or query_range; the expression is pushed, never evaluated here."""
    from urllib.parse import urlencode

    return f"{base}/api/v1/{kind}" + ("?" + urlencode(parameters) if parameters else "")


def fetched(spark: SparkSession, urls: list[str], get: Callable[[str], str] | None = None) -> DataFrame:
    """(url, body) by the HTTP source, or by a function that stands for the store."""
    if get is not None:
        return spark.createDataFrame([(u, get(u)) for u in urls], "url string, body string")
    spark.dataSource.register(HttpReplies)
    return spark.read.format("http_replies").option("urls", "\n".join(urls)).load()


# Sample alerts and logs of an operations console.
SAMPLE_ALERTS = (
    ("HighCPUUsage", "firing", "critical", "payment-service", "127.0.0.1:8080", "2025-06-15T10:23:00Z"),
    ("HighMemoryUsage", "firing", "warning", "order-service", "127.0.0.1:8080", "2025-06-15T10:25:00Z"),
    ("SlowResponse", "firing", "warning", "user-service", "127.0.0.1:8080", "2025-06-15T10:28:00Z"),
)
SAMPLE_LOGS = (
    ("system-metrics", "2025-06-15T10:22:15.000Z", "WARN", "127.0.0.1", "payment-service", "CPU 使用率达到 92%，超过告警阈值 80%"),
    ("system-metrics", "2025-06-15T10:23:30.000Z", "WARN", "127.0.0.1", "order-service", "内存使用率达到 91%，超过告警阈值 85%"),
    ("system-metrics", "2025-06-15T10:24:00.000Z", "INFO", "127.0.0.1", "payment-service", "磁盘 I/O 等待时间升高，iowait 达到 35%"),
    ("application-logs", "2025-06-15T10:22:45.123Z", "ERROR", "127.0.0.1", "payment-service", "PaymentProcessingException: 支付回调处理失败，第三方网关超时"),
    ("application-logs", "2025-06-15T10:23:15.456Z", "WARN", "127.0.0.1", "order-service", "数据库连接池使用率达到 85%，活跃连接数 170/200"),
    ("application-logs", "2025-06-15T10:25:00.789Z", "ERROR", "127.0.0.1", "user-service", "RedisConnectionException: 无法连接到 Redis 集群，连接超时"),
    ("database-slow-query", "2025-06-15T10:20:00.000Z", "WARN", "127.0.0.1", "order-service", "慢查询检测: SELECT 查询耗时 3.5s，超过阈值 1s"),
    ("database-slow-query", "2025-06-15T10:21:30.000Z", "WARN", "127.0.0.1", "user-service", "慢查询检测: UPDATE 语句耗时 2.1s，超过阈值 1s"),
    ("system-events", "2025-06-15T10:00:00.000Z", "INFO", "ci-cd-system", "payment-service", "服务部署完成: payment-service v2.3.1 -> v2.4.0"),
    ("system-events", "2025-06-15T10:10:00.000Z", "INFO", "hpa-controller", "order-service", "HPA 触发扩容: order-service 副本数 3 -> 5"),
    ("system-events", "2025-06-15T09:50:00.000Z", "INFO", "config-center", "user-service", "配置变更: user-service 数据库连接池参数调整"),
)


def sample_alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_ALERTS, "alert_name string, state string, severity string, service_name string, instance string, fired_at string")


def sample_logs(spark: SparkSession) -> DataFrame:
    rows = [(*r, json.dumps({})) for r in SAMPLE_LOGS]
    out = spark.createDataFrame(rows, "topic string, timestamp string, level string, source string, service_name string, message string, m string")
    return out.withColumn("metadata", F.from_json("m", "map<string, string>")).drop("m")
