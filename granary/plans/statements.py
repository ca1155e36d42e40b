"""The console's statements as registered queries: point reads, ordered lists, counts and immutable rewrites, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import budget, ingest, memory, relational
from .catalog import query
from .queries import table

# Views over the driver's tables that stand for the console's tables, in SQL and as DataFrames.
_CHAT = "chat AS (SELECT conv_id * 100 + turn AS id, 'session-' || conv_id AS session_id, 't' || (conv_id % 3) AS tenant_id, 'u' || (conv_id % 5) AS owner_user_id, role, text, turn AS create_time FROM conversations)"
_DOCS = "docs AS (SELECT doc_id AS document_id, lang AS tenant_id, source AS owner_user_id, doc_id % 7 AS knowledge_base_id, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS deleted_flag, 'success' AS status, CAST(NULL AS VARCHAR) AS error_message, sha256(coalesce(text, '')) AS content_hash, n_chars AS create_time FROM documents)"
_TASKS = "tasks AS (SELECT o_orderkey AS task_id, o_custkey AS document_id, o_orderstatus AS status, o_orderkey % 9 AS progress, o_orderdate AS create_time FROM orders)"
_KBS = "kbs AS (SELECT c_custkey AS kb_id, 't' || (c_custkey % 3) AS tenant_id, 'u' || (c_custkey % 5) AS owner_user_id, c_name AS name, 0 AS deleted_flag FROM customer)"
_TRACES = "traces AS (SELECT event_id AS trace_id, 'session-' || (user_id % 40) AS session_id, 't' || (user_id % 3) AS tenant_id, 'u' || (user_id % 5) AS owner_user_id, event_type AS agent_id, CAST(event_id % 10 AS BIGINT) AS retrieval_topk, ts AS create_time FROM events)"
_USERS = "users AS (SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role, 1 AS status, c_acctbal AS create_time FROM customer)"
_MEMORY = "memory AS (SELECT doc_id AS memory_id, lang AS tenant_id, source AS user_id, '/' || lang || '/' || (doc_id % 4) AS scope, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 1 END AS status, n_chars AS created_at, CASE WHEN doc_id % 6 = 0 THEN n_chars END AS expires_at FROM documents)"
_ALERTS = "alerts AS (SELECT event_id AS alert_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'info' ELSE event_type END AS severity, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, ts AS alert_time FROM events)"
_AUDIT = "audit AS (SELECT event_id AS id, user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS result, ts AS create_time FROM events)"


def _text(c: Column) -> Column:
    return c.cast("string")


def _owned(df: DataFrame, key: str, tenant: str = "t", owner: str = "u") -> DataFrame:
    return df.withColumn("tenant_id", F.concat(F.lit(tenant), _text(F.col(key) % 3))).withColumn("owner_user_id", F.concat(F.lit(owner), _text(F.col(key) % 5)))


def _chat(s, d):
    c = table(s, d, "conversations")
    return _owned(c, "conv_id").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("session-"), _text(F.col("conv_id"))).alias("session_id"), "tenant_id", "owner_user_id", "role", "text", F.col("turn").alias("create_time"))


def _docs(s, d):
    rows = ingest.hashed(table(s, d, "documents"))
    return rows.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("tenant_id"), F.col("source").alias("owner_user_id"), (F.col("doc_id") % 7).alias("knowledge_base_id"), F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("deleted_flag"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"), "content_hash", F.col("n_chars").alias("create_time"))


def _tasks(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 9).alias("progress"), F.col("o_orderdate").alias("create_time"))


def _kbs(s, d):
    return _owned(table(s, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("kb_id"), "tenant_id", "owner_user_id", F.col("c_name").alias("name"), F.lit(0).alias("deleted_flag"))


def _traces(s, d):
    e = _owned(table(s, d, "events"), "user_id")
    return e.select(F.col("event_id").alias("trace_id"), F.concat(F.lit("session-"), _text(F.col("user_id") % 40)).alias("session_id"), "tenant_id", "owner_user_id", F.col("event_type").alias("agent_id"), (F.col("event_id") % 10).alias("retrieval_topk"), F.col("ts").alias("create_time"))


def _users(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"), F.lit(1).alias("status"), F.col("c_acctbal").alias("create_time"))


def _memory(s, d):
    rows = ingest.hashed(table(s, d, "documents"))
    return rows.select(F.col("doc_id").alias("memory_id"), F.col("lang").alias("tenant_id"), F.col("source").alias("user_id"), F.concat(F.lit("/"), "lang", F.lit("/"), _text(F.col("doc_id") % 4)).alias("scope"), "content_hash", F.when(F.col("doc_id") % 8 == 0, 0).otherwise(1).alias("status"), F.col("n_chars").alias("created_at"), F.when(F.col("doc_id") % 6 == 0, F.col("n_chars")).alias("expires_at"))


def _alerts(s, d):
    e = table(s, d, "events")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "click", "info").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("alert_id"), severity.alias("severity"), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("active").alias("status"), F.col("ts").alias("alert_time"))


def _audit(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("result"), F.col("ts").alias("create_time"))


def _add(name: str, view: str, sql: str, rows, make) -> None:
    query(name, f"WITH {view} {sql}")(lambda s, d: make(rows(s, d)))


_SCOPE = "tenant_id = 't1' AND owner_user_id = 'u1'"


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """An ordered, scoped list with each row's place in it, so that the order is compared too."""
    return df.select(*columns, F.monotonically_increasing_id().alias("_m")).select(*columns, (F.row_number().over(Window.orderBy("_m")) - 1).cast("long").alias("place"))


def _mine(df: DataFrame) -> DataFrame:
    return relational.scoped(df, "t1", "u1")


# alerts
_add("alert_insert", _ALERTS, "SELECT * FROM alerts UNION ALL SELECT alert_id + 1000000000, severity, 'active', alert_time FROM alerts WHERE severity = 'critical'", _alerts, lambda a: relational.inserted(a, relational.create_alert(a.where("severity = 'critical'").withColumn("alert_id", F.col("alert_id") + 1000000000))))
_add("alert_by_id", _ALERTS, "SELECT * FROM alerts WHERE alert_id = 17", _alerts, lambda a: relational.point(a, alert_id=17))
_add("alert_list", _ALERTS, "SELECT alert_id FROM alerts WHERE status = 'active'", _alerts, lambda a: relational.active_alerts(a, "all").select("alert_id"))
_add("alerts_page", _ALERTS, "SELECT alert_id FROM alerts ORDER BY alert_time DESC, alert_id DESC LIMIT 20 OFFSET 40", _alerts, lambda a: relational.page_of(a, [F.desc("alert_time"), F.desc("alert_id")], 3, 0).select("alert_id"))
_add("alert_count", _ALERTS, "SELECT count(*) AS n FROM alerts", _alerts, lambda a: relational.count_matching(a))
_add("alert_count_by_severity", _ALERTS, "SELECT count(*) AS n FROM alerts WHERE severity = 'warning' AND status = 'active'", _alerts, lambda a: relational.count_matching(a, F.col("severity") == "warning", F.col("status") == "active"))
_add("alert_status_update", _ALERTS, "SELECT alert_id, CASE WHEN alert_id = 17 THEN 'acknowledged' ELSE status END AS status FROM alerts", _alerts, lambda a: relational.updated(a, F.col("alert_id") == 17, status="acknowledged").select("alert_id", "status"))
_add("alert_delete", _ALERTS, "SELECT alert_id FROM alerts WHERE alert_id <> 17", _alerts, lambda a: relational.deleted(a, F.col("alert_id") == 17).select("alert_id"))

# audit log
_add("audit_insert", _AUDIT, "SELECT * FROM audit UNION ALL SELECT id + 1000000000, user_id, left(action, 3), result, create_time FROM audit WHERE result = 'FAILURE'", _audit, lambda a: relational.inserted(a, a.where("result = 'FAILURE'").withColumn("id", F.col("id") + 1000000000).withColumn("action", F.left("action", F.lit(3)))))
_add("audit_page", _AUDIT, "SELECT id FROM audit WHERE user_id = 7 AND result = 'SUCCESS' AND create_time <= TIMESTAMP '2024-01-25' ORDER BY create_time DESC, id DESC LIMIT 20", _audit, lambda a: relational.page_of(relational.matching(a, {"user_id": 7, "result": "SUCCESS", "action": ""}, None, ("create_time", "2024-01-25")), [F.desc("create_time"), F.desc("id")], 0, 0).select("id"))
_add("audit_count", _AUDIT, "SELECT count(*) AS n FROM audit WHERE user_id = 7 AND action = 'click'", _audit, lambda a: relational.count_matching(a, F.col("user_id") == 7, F.col("action") == "click"))

# chat history
_add("chat_insert", _CHAT, "SELECT id, text FROM chat UNION ALL SELECT id + 50, text FROM chat WHERE role = 'system'", _chat, lambda c: relational.inserted(c, c.where("role = 'system'").withColumn("id", F.col("id") + 50)).select("id", "text"))
_add("chat_by_scope", _CHAT, f"SELECT id, create_time, row_number() OVER (ORDER BY create_time, id) - 1 AS place FROM chat WHERE {_SCOPE}", _chat, lambda c: _placed(relational.oldest_first(_mine(c), "create_time", "id"), "id", "create_time"))
_add("chat_by_id", _CHAT, "SELECT * FROM chat WHERE id = 101", _chat, lambda c: relational.point(c, id=101))
_add("chat_by_id_scoped", _CHAT, f"SELECT id FROM chat WHERE id = 101 AND {_SCOPE}", _chat, lambda c: relational.point(_mine(c), id=101).select("id"))
_add("chat_delete_scope", _CHAT, f"SELECT id FROM chat WHERE NOT ({_SCOPE})", _chat, lambda c: relational.deleted(c, (F.col("tenant_id") == "t1") & (F.col("owner_user_id") == "u1")).select("id"))
_add("chat_delete_id", _CHAT, "SELECT id FROM chat WHERE id <> 101", _chat, lambda c: relational.deleted(c, F.col("id") == 101).select("id"))
_add("chat_delete_id_scoped", _CHAT, f"SELECT id FROM chat WHERE NOT (id = 101 AND {_SCOPE})", _chat, lambda c: relational.deleted(c, (F.col("id") == 101) & (F.col("tenant_id") == "t1") & (F.col("owner_user_id") == "u1")).select("id"))
_SESSIONS = _CHAT + ", sessions AS (SELECT DISTINCT session_id, tenant_id, owner_user_id FROM chat)"


def _sessions(s, d):
    return relational.distinct_scopes(_chat(s, d), "session_id", "tenant_id", "owner_user_id")


_add("session_insert", _SESSIONS, "SELECT session_id FROM sessions UNION ALL SELECT 'new-' || session_id FROM sessions WHERE tenant_id = 't0'", _sessions, lambda x: relational.inserted(x, x.where("tenant_id = 't0'").withColumn("session_id", F.concat(F.lit("new-"), "session_id"))).select("session_id"))
_add("session_by_id", _SESSIONS, "SELECT * FROM sessions WHERE session_id = 'session-1'", _sessions, lambda x: relational.point(x, session_id="session-1"))
_add("session_by_id_scoped", _SESSIONS, f"SELECT * FROM sessions WHERE session_id = 'session-1' AND {_SCOPE}", _sessions, lambda x: relational.point(_mine(x), session_id="session-1"))
_add("chat_by_session", _CHAT, f"SELECT id, role, create_time FROM chat WHERE session_id = 'session-1' AND {_SCOPE} ORDER BY create_time", _chat, lambda c: relational.oldest_first(relational.point(_mine(c), session_id="session-1"), "create_time").select("id", "role", "create_time"))

# document metadata
_DOC_SCOPE = "tenant_id = 'en' AND owner_user_id = 'src1'"


def _our(df: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    return relational.scoped(df, "en", "src1", owner_col=owner)


_add("doc_insert", _DOCS, "SELECT document_id, status FROM docs UNION ALL SELECT document_id + 1000000000, 'processing' FROM docs WHERE deleted_flag = 1", _docs, lambda x: relational.inserted(x, x.where("deleted_flag = 1").withColumn("document_id", F.col("document_id") + 1000000000).withColumn("status", F.lit(None).cast("string")), {"status": F.lit("processing")}).select("document_id", "status"))
_add("docs_by_scope", _DOCS, f"SELECT document_id, row_number() OVER (ORDER BY create_time DESC, document_id DESC) - 1 AS place FROM docs WHERE {_DOC_SCOPE} AND deleted_flag = 0", _docs, lambda x: _placed(relational.newest_first(relational.live(_our(x)), "create_time", "document_id"), "document_id"))
_add("docs_by_scope_kb", _DOCS, f"SELECT document_id FROM docs WHERE {_DOC_SCOPE} AND deleted_flag = 0 AND knowledge_base_id = 3", _docs, lambda x: relational.newest_first(relational.point(relational.live(_our(x)), knowledge_base_id=3), "create_time").select("document_id"))
_add("doc_by_id", _DOCS, "SELECT * FROM docs WHERE document_id = 21 AND deleted_flag = 0", _docs, lambda x: relational.point(relational.live(x), document_id=21))
_add("doc_by_id_scoped", _DOCS, f"SELECT document_id FROM docs WHERE document_id = 21 AND deleted_flag = 0 AND {_DOC_SCOPE}", _docs, lambda x: relational.point(relational.live(_our(x)), document_id=21).select("document_id"))
_add("doc_status_update", _DOCS, "SELECT document_id, CASE WHEN document_id = 11 THEN 'failed' ELSE status END AS status, CASE WHEN document_id = 11 THEN 'broken' ELSE error_message END AS error_message FROM docs", _docs, lambda x: relational.updated(x, F.col("document_id") == 11, status="failed", error_message="broken").select("document_id", "status", "error_message"))
_add("doc_soft_delete", _DOCS, f"SELECT document_id, CASE WHEN {_DOC_SCOPE} THEN 1 ELSE deleted_flag END AS deleted_flag FROM docs", _docs, lambda x: relational.soft_deleted(x, (F.col("tenant_id") == "en") & (F.col("owner_user_id") == "src1")).select("document_id", "deleted_flag"))
_add("doc_count_by_hash", _DOCS, f"SELECT content_hash, count(*) AS n FROM docs WHERE deleted_flag = 0 AND {_DOC_SCOPE} GROUP BY content_hash", _docs, lambda x: relational.live(_our(x)).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")))

# extraction tasks
_add("task_insert", _TASKS, "SELECT task_id FROM tasks UNION ALL SELECT task_id + 1000000000 FROM tasks WHERE status = 'P'", _tasks, lambda x: relational.inserted(x, x.where("status = 'P'").withColumn("task_id", F.col("task_id") + 1000000000)).select("task_id"))
_add("task_by_id", _TASKS, "SELECT * FROM tasks WHERE task_id = 33", _tasks, lambda x: relational.point(x, task_id=33))
_add("task_by_document", _TASKS, "SELECT task_id FROM tasks WHERE document_id = 7 ORDER BY create_time DESC, task_id DESC LIMIT 1", _tasks, lambda x: relational.first_by(relational.point(x, document_id=7), [F.desc("create_time"), F.desc("task_id")]).select("task_id"))
_add("task_status_update", _TASKS, "SELECT task_id, CASE WHEN document_id = 7 THEN 'F' ELSE status END AS status, CASE WHEN document_id = 7 THEN progress + 5 ELSE progress END AS progress FROM tasks", _tasks, lambda x: relational.updated(x, F.col("document_id") == 7, status="F", progress=F.col("progress") + 5).select("task_id", "status", "progress"))

# knowledge bases
_KB_COUNT = f"SELECT kb_id, name, count(o_orderkey) AS document_count FROM kbs LEFT JOIN orders ON o_custkey = kb_id AND o_orderstatus = 'O' WHERE {_SCOPE} AND deleted_flag = 0"


def _counted(s, d):
    orders = table(s, d, "orders").withColumnRenamed("o_custkey", "kb_id")
    return relational.with_document_counts(relational.live(_mine(_kbs(s, d))).select("kb_id", "name"), orders, ["kb_id"], F.col("o_orderstatus") == "O")


_add("kbs_by_scope", _KBS, _KB_COUNT + " GROUP BY kb_id, name", _counted, lambda x: x)
_add("kb_by_id", _KBS, _KB_COUNT + " AND kb_id = 16 GROUP BY kb_id, name", _counted, lambda x: relational.point(x, kb_id=16))
_add("kb_insert", _KBS, "SELECT kb_id, name FROM kbs UNION ALL SELECT kb_id + 1000000000, 'new' FROM kbs WHERE tenant_id = 't0'", _kbs, lambda x: relational.inserted(x, x.where("tenant_id = 't0'").withColumn("kb_id", F.col("kb_id") + 1000000000).withColumn("name", F.lit("new"))).select("kb_id", "name"))
_add("kb_soft_delete", _KBS, f"SELECT kb_id, CASE WHEN kb_id = 16 AND {_SCOPE} THEN 1 ELSE deleted_flag END AS deleted_flag FROM kbs", _kbs, lambda x: relational.soft_deleted(x, (F.col("kb_id") == 16) & (F.col("tenant_id") == "t1") & (F.col("owner_user_id") == "u1")).select("kb_id", "deleted_flag"))

# traces
_add("trace_insert", _TRACES, "SELECT trace_id FROM traces UNION ALL SELECT trace_id + 1000000000 FROM traces WHERE agent_id = 'error'", _traces, lambda x: relational.inserted(x, x.where("agent_id = 'error'").withColumn("trace_id", F.col("trace_id") + 1000000000)).select("trace_id"))
_add("trace_by_id", _TRACES, f"SELECT trace_id, agent_id FROM traces WHERE trace_id = (SELECT min(trace_id) FROM traces WHERE {_SCOPE}) AND {_SCOPE} LIMIT 1", _traces, lambda x: relational.first_by(relational.point(_mine(x), trace_id=_mine(x).agg(F.min("trace_id")).first()[0]), [F.asc("trace_id")]).select("trace_id", "agent_id"))
_add("traces_by_session", _TRACES, f"SELECT trace_id, create_time FROM traces WHERE session_id = 'session-1' AND {_SCOPE} ORDER BY create_time, trace_id", _traces, lambda x: relational.oldest_first(relational.point(_mine(x), session_id="session-1"), "create_time", "trace_id").select("trace_id", "create_time"))
_add("trace_admin_page", _TRACES, "SELECT trace_id FROM traces WHERE tenant_id = 't1' AND agent_id = 'click' AND create_time >= TIMESTAMP '2024-01-03' ORDER BY create_time DESC, trace_id DESC LIMIT 100 OFFSET 100", _traces, lambda x: relational.page_of(relational.matching(x, {"tenant_id": relational.admin_tenant(" ", "t1"), "owner_user_id": None, "agent_id": "click"}, ("create_time", "2024-01-03")), [F.desc("create_time"), F.desc("trace_id")], 2, 1000).select("trace_id"))
_add("trace_admin_count", _TRACES, "SELECT count(*) AS n FROM traces WHERE tenant_id = 't1' AND agent_id = 'click'", _traces, lambda x: relational.count_matching(x, F.col("tenant_id") == "t1", F.col("agent_id") == "click"))
_add("trace_stat_by_user", _TRACES, "SELECT owner_user_id AS key, count(*) AS total, round(avg(retrieval_topk), 6) AS mean FROM traces GROUP BY 1", _traces, lambda x: relational.mean_stats(x, F.col("owner_user_id"), "retrieval_topk").withColumn("mean", F.round("mean", 6)))

# users
_add("user_insert", _USERS, "SELECT id, username FROM users UNION ALL SELECT id + 1000000000, 'x' || username FROM users WHERE role = 'BUILDING'", _users, lambda x: relational.inserted(x, x.where("role = 'BUILDING'").withColumn("id", F.col("id") + 1000000000).withColumn("username", F.concat(F.lit("x"), "username"))).select("id", "username"))
_add("user_by_name", _USERS, "SELECT * FROM users WHERE username = 'Customer#000000007'", _users, lambda x: relational.point(x, username="Customer#000000007"))
_add("user_by_id", _USERS, "SELECT * FROM users WHERE id = 7", _users, lambda x: relational.point(x, id=7))
_add("users_page", _USERS, "SELECT id FROM users ORDER BY create_time DESC, id DESC LIMIT 20 OFFSET 20", _users, lambda x: relational.page_of(x, [F.desc("create_time"), F.desc("id")], 2, 20).select("id"))
_add("user_count", _USERS, "SELECT count(*) AS n FROM users", _users, lambda x: relational.count_matching(x))
_add("user_status_update", _USERS, "SELECT id, CASE WHEN id = 7 THEN 0 ELSE status END AS status, CASE WHEN id = 9 THEN 'admin' ELSE role END AS role FROM users", _users, lambda x: relational.updated(relational.updated(x, F.col("id") == 7, status=0), F.col("id") == 9, role="admin").select("id", "status", "role"))
_add("user_update", _USERS, "SELECT CASE WHEN id = 7 THEN 'renamed' ELSE username END AS username, id, CASE WHEN id = 7 THEN 'r' ELSE role END AS role, CASE WHEN id = 7 THEN 0 ELSE status END AS status FROM users", _users, lambda x: relational.updated(x, F.col("id") == 7, username="renamed", role="r", status=0).select("id", "username", "role", "status"))

# memory rows
_M = "tenant_id = 'en' AND user_id = 'src1'"


def _own(df: DataFrame) -> DataFrame:
    return _our(df, "user_id").where("status = 1")


_add("memory_insert", _MEMORY, "SELECT memory_id, scope, status FROM memory UNION ALL SELECT memory_id + 1000000000, '/', 1 FROM memory WHERE status = 0", _memory, lambda x: relational.insert_memory(x, x.where("status = 0").select((F.col("memory_id") + 1000000000).alias("memory_id"), F.lit(None).cast("string").alias("scope"), "tenant_id", "user_id", "content_hash", F.lit(None).cast("int").alias("status")), F.lit(None).cast("long")).select("memory_id", "scope", "status"))
_add("memory_by_id", _MEMORY, "SELECT memory_id FROM memory WHERE memory_id = 21 AND status = 1 LIMIT 1", _memory, lambda x: relational.first_by(relational.point(x, memory_id=21, status=1), [F.asc("memory_id")]).select("memory_id"))
_add("memory_by_owner", _MEMORY, f"SELECT memory_id, row_number() OVER (ORDER BY created_at DESC, memory_id DESC) - 1 AS place FROM memory WHERE {_M} AND status = 1", _memory, lambda x: _placed(relational.newest_first(_own(x), "created_at", "memory_id"), "memory_id"))
_add("memory_by_scope", _MEMORY, "SELECT memory_id FROM memory WHERE starts_with(scope, '/en/1') AND status = 1", _memory, lambda x: relational.scope_prefix(x.where("status = 1"), "scope", "/en/1").select("memory_id"))
_add("memory_recent", _MEMORY, f"SELECT memory_id FROM memory WHERE {_M} AND status = 1 AND starts_with(scope, '/en') ORDER BY created_at DESC, memory_id DESC LIMIT 5", _memory, lambda x: relational.recent(relational.scope_prefix(_own(x), "scope", "/en"), 5).select("memory_id"))
_add("memory_hash_count", _MEMORY, "SELECT count(*) AS n FROM memory WHERE status = 1 AND scope = '/en/1' AND content_hash = (SELECT content_hash FROM memory WHERE memory_id = 21)", _memory, lambda x: relational.count_matching(x.join(relational.point(x, memory_id=21).select("content_hash"), "content_hash", "left_semi"), F.col("status") == 1, F.col("scope") == "/en/1"))
_add("memory_soft_delete", _MEMORY, "SELECT memory_id, CASE WHEN memory_id = 21 THEN 0 ELSE status END AS status FROM memory", _memory, lambda x: relational.updated(x, F.col("memory_id") == 21, status=0).select("memory_id", "status"))
_add("memory_content_update", _MEMORY, "SELECT memory_id, CASE WHEN memory_id = 21 THEN sha256('new') ELSE content_hash END AS content_hash FROM memory", _memory, lambda x: relational.updated(x, F.col("memory_id") == 21, content_hash=F.sha2(F.lit("new").cast("binary"), 256)).select("memory_id", "content_hash"))
_add("memory_delete_expired", _MEMORY, "SELECT memory_id FROM memory WHERE expires_at IS NULL OR expires_at >= 500", _memory, lambda x: relational.expired(x, F.lit(500)).select("memory_id"))
_add("memory_forget", _MEMORY, f"SELECT memory_id, CASE WHEN {_M} AND starts_with(scope, '/en/1') THEN 0 ELSE status END AS status FROM memory", _memory, lambda x: memory.forget_scope(x, "en", "src1", "/en/1").select("memory_id", "status"))

# derived results
_add("branch_and_intent", _CHAT, "SELECT id, CASE WHEN id % 3 = 0 THEN 'RAG' WHEN id % 4 > 1 THEN 'TOOL_CALL' ELSE 'DIRECT_ANSWER' END AS branch, CASE WHEN id % 3 = 0 THEN 'knowledge_query' WHEN id % 4 > 1 THEN 'tool_invocation' ELSE 'general_chat' END AS intent FROM chat", _chat, lambda c: c.select("id", *[x.alias(n) for x, n in zip(relational.branch_and_intent(F.col("id") % 3 == 0, F.greatest(F.col("id") % 4 - 1, F.lit(0))), ("branch", "intent"), strict=True)]))
_add("tool_call_log", _CHAT, "SELECT id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS input, role AS output, row_number() OVER (PARTITION BY session_id ORDER BY create_time) AS order_no FROM chat", _chat, lambda c: budget.tool_call_log(c.withColumn("input", F.col("text")).withColumn("output", F.col("role")), "session_id", ["create_time"]).select("id", "input", "output", F.col("order_no").cast("long").alias("order_no")))
