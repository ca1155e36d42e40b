"""A scored memory store: remember, conflicts, recall with decay, two tiers and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, unfenced
from .near import near_join
from .retrieve import nearest
from .tables import written

# Kinds of memories.
TYPES = ("FACT", "PREFERENCE", "DECISION", "EPISODE", "KNOWLEDGE")


def unseen(new: DataFrame, store: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new whose content is not in store for the same keys; of equal ones in new the first."""
    hashed = new.withColumn("content_hash", digest(F.col("content")))
    w = Window.partitionBy("content_hash", *keys).orderBy(order)
    first = hashed.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")
    return first.join(store.where("status = 1").select("content_hash", *keys).distinct(), ["content_hash", *keys], "left_anti")


def importance_of(reply: Column) -> Column:
    """A model's importance: the digits and dots of its reply as a number, else 0.5; not clamped."""
    return F.coalesce(F.regexp_replace(reply, "[^0-9.]", "").try_cast("double"), F.lit(0.5))


def stored(facts: DataFrame, now: Column, ttl_days: int | None = None, importance: Column | None = None) -> DataFrame:
    """facts as store rows: an episode has importance 0.6, others what is given or 0.5; expiry is now and the time to live."""
    given = F.lit(0.5) if importance is None else importance
    rows = facts.withColumn("importance", F.when(F.col("type") == "EPISODE", F.lit(0.6)).otherwise(given)).withColumn("status", F.lit(1)).withColumn("created_at", now)
    return rows.withColumn("expires_at", F.lit(None).cast("timestamp_ntz") if ttl_days is None else now + F.expr(f"INTERVAL {int(ttl_days)} DAYS"))


def conflicts(new: DataFrame, store: DataFrame, decide, similar: float = 0.7, certain: float = 0.85) -> DataFrame:
    """new with old_id and action where a stored memory of the same owner is nearly the same.

    Of the nearest stored rows over `similar` the first over `certain` decides, and the nearest one is the first. It gets a decision by `decide`, a
    function that adds action (UPDATE, DELETE, KEEP, MERGE) to a DataFrame. Without such a row action is ADD. An owner's rows are not all compared: see near.near_join.
    """
    owner = ["tenant_id", "user_id"]
    side = lambda df: df.select(F.col("memory_id").alias("id"), F.col("embedding").alias("v"), *owner)
    pairs, _ = near_join(side(new), side(store.where("status = 1")), owner, similar)
    texts = lambda df, name, content: df.select(F.col("memory_id").alias(name), F.col("content").alias(content))
    scored = pairs.select(F.col("left_id").alias("memory_id"), F.col("right_id").alias("old_id"), "sim")
    w = Window.partitionBy("memory_id").orderBy(F.desc("sim"), "old_id")
    best = scored.withColumn("_i", F.row_number().over(w)).where((F.col("_i") == 1) & (F.col("sim") > certain))
    best = best.drop("_i").join(texts(new, "memory_id", "content"), "memory_id").join(texts(store.where("status = 1"), "old_id", "old_content"), "old_id")
    decided = decide(best.select("memory_id", "old_id", "content", "old_content", "sim")).select("memory_id", "old_id", "action")
    return new.join(decided, "memory_id", "left").withColumn("action", F.coalesce("action", F.lit("ADD")))


def resolved(store: DataFrame, decided: DataFrame) -> DataFrame:
    """The store after decisions: UPDATE replaces the old content, DELETE drops the old row and adds the new, KEEP drops the new one, others add it.

    Of several rows that update one the largest memory_id counts; a row that is both updated and deleted goes.
    """
    update = decided.where("action = 'UPDATE'").groupBy(F.col("old_id").alias("memory_id")).agg(F.max_by("content", "memory_id").alias("_c"))
    gone = decided.where("action = 'DELETE'").select(F.col("old_id").alias("memory_id")).distinct()
    kept = store.join(gone, "memory_id", "left_anti").join(update, "memory_id", "left")
    kept = kept.withColumn("content_hash", F.when(F.col("_c").isNotNull(), digest(F.col("_c"))).otherwise(F.col("content_hash"))).withColumn("content", F.coalesce("_c", "content")).drop("_c")
    added = decided.where("action not in ('UPDATE', 'KEEP')").drop("old_id", "action")
    return kept.select(*store.columns).unionByName(added, allowMissingColumns=True).select(*store.columns)


def remembered(store: DataFrame, new: DataFrame, decide, order: str = "memory_id", **limits: float) -> tuple[DataFrame, DataFrame]:
    """(store, decided): what a call adds, in one flow. new: memory_id, content, embedding, tenant_id, user_id, scope and the store's other columns.

    First rows go whose content the same owner has in the same scope, and later ones of equal rows; the others get their decisions (see conflicts). Of those that would be stored (ADD, DELETE,
    MERGE) rows go whose content the owner has in any scope: action SEEN. The rest is done by resolved. decided has a row for each row that passed the first check.
    """
    owner = ["tenant_id", "user_id"]
    first = written(unseen(new, store, [*owner, "scope"], order), "unseen")
    decided = written(conflicts(first, store, decide, **limits), "decided")
    known = store.where("status = 1").select("content_hash", *owner).distinct().withColumn("_known", F.lit(True))
    seen = F.coalesce("_known", F.lit(False)) & ~F.col("action").isin("UPDATE", "KEEP")
    told = decided.join(known, ["content_hash", *owner], "left").withColumn("action", F.when(seen, "SEEN").otherwise(F.col("action"))).drop("_known")
    told = written(told.select(*decided.columns), "told")
    return resolved(store, told.where("action <> 'SEEN'")), told


def recency(created: Column, now: Column, half_life: float = 30.0) -> Column:
    """0.5 ^ (whole days / half-life); a day is 86400 seconds, not a date."""
    days = F.timestamp_diff("DAY", created, now)
    return F.pow(F.lit(0.5), days / F.lit(half_life))


def composite(semantic: Column, recent: Column, importance: Column) -> Column:
    return 0.5 * semantic + 0.3 * recent + 0.2 * importance


def recall(store: DataFrame, queries: DataFrame, now: Column, limit: int = 10, semantic: float = 0.55, least: float = 0.3, half_life: float = 30.0, overfetch: int = 3) -> DataFrame:
    """(query_id, memory_id, semantic, recency, composite, rank): what queries (query_id, query_vec) recall from active rows.

    The `limit * overfetch` most similar rows are scored; those under either limit go, whatever the other says. The most similar rows come from one
    matrix product a batch, see retrieve.nearest.
    """
    active = store.where("status = 1").select("memory_id", "embedding", "created_at", "importance")
    rows = nearest(active, queries, limit * overfetch, "cosine", "memory_id", "embedding").withColumnRenamed("score", "semantic")
    w = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "memory_id")
    near = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= limit * overfetch)
    near = near.withColumn("recency", recency(F.col("created_at"), now, half_life))
    near = near.withColumn("composite", composite(F.col("semantic"), F.col("recency"), F.col("importance"))).where((F.col("semantic") >= semantic) & (F.col("composite") >= least))
    w = Window.partitionBy("query_id").orderBy(F.desc("composite"), "memory_id")
    out = near.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < limit)
    return out.select("query_id", "memory_id", F.round("semantic", 6).alias("semantic"), F.round("recency", 6).alias("recency"), F.round("composite", 6).alias("composite"), "rank")


def recent_without_vectors(store: DataFrame, tenant: str, user: str, prefix: str | None, now: Column, embed, query: str, limit: int = 10, overfetch: int = 3, **limits) -> DataFrame:
    """Recall where there is no vector store: the newest rows of the scope get their vectors now (embed: from DataFrame with content to one with embedding).

    A search for similar memories finds nothing there, so conflicts are never seen.
    """
    rows = store.where((F.col("status") == 1) & (F.col("tenant_id") == tenant) & (F.col("user_id") == user))
    rows = rows if prefix is None else rows.where(F.col("scope").startswith(prefix))
    newest = embed(rows.orderBy(F.desc("created_at"), F.desc("memory_id")).limit(limit * overfetch))
    asked = embed(store.sparkSession.createDataFrame([(0, query)], "query_id long, content string")).select("query_id", F.col("embedding").alias("query_vec"))
    return recall(newest, asked, now, limit, overfetch=overfetch, **limits)


def two_tiers(session: DataFrame, agent: DataFrame, limit: int = 5, enough: int = 3) -> DataFrame:
    """(query_id, memory_id, composite, tier, rank): session hits first; where there are under `enough`, agent hits that are not among them, up to `limit`."""
    s = session.where(F.col("rank") < limit).select("query_id", "memory_id", "composite", F.col("rank").alias("_r"), F.lit(0).alias("tier"))
    n = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    a = agent.select("query_id", "memory_id", "composite", F.col("rank").alias("_r"), F.lit(1).alias("tier"))
    a = a.join(n, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < enough).drop("_n").join(s.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("tier", "_r")
    return s.unionByName(a).withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < limit).drop("_r")


def recalled_lines(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, lines): 'i. [p%相关] text' for each hit in order."""
    rows = hits.join(texts.select("memory_id", "content"), "memory_id")
    line = F.format_string("%d. [%d%%相关] %s", F.col("rank") + 1, F.floor(F.col("composite") * 100 + 0.5).cast("int"), F.col("content"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


def without_duplicates(store: DataFrame) -> DataFrame:
    """Active rows with one content and scope: the newest stays active, the others get status 0.

    The newest of each is found by an aggregation and meets its own row by memory_id, which tells rows apart; rows of one content never meet. Rows without a hash or scope stay.
    """
    known = (F.col("status") == 1) & F.col("content_hash").isNotNull() & F.col("scope").isNotNull()
    newest = store.where(known).groupBy("content_hash", "scope").agg(F.max(F.struct("created_at", "memory_id")).alias("_top")).select(F.col("_top")["memory_id"].alias("memory_id"), F.lit(True).alias("_newest"))
    rows = store.join(newest, "memory_id", "left")
    return rows.withColumn("status", F.when(known & F.col("_newest").isNull(), 0).otherwise(F.col("status"))).select(*store.columns)


def _vectors(store: DataFrame, keys: list[str]) -> DataFrame:
    return written(store.where("status = 1").select(F.col("memory_id").alias("id"), F.col("embedding").alias("v"), *keys).where("v is not null"), "vectors")


def near_pairs(store: DataFrame, keys: list[str], similar: float = 0.9) -> DataFrame:
    """(a, b, sim) of active rows with equal keys whose embeddings are over `similar`: every pair once, a < b; exact, see near.near_join."""
    rows = _vectors(store, keys)
    return near_join(rows, rows, keys, similar, itself=True)[0].select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "sim")


def merged_into(pairs: DataFrame) -> DataFrame:
    """(a, b): which row takes up which, of pairs (a, b) with a < b that are to be merged.

    As if rows were visited by their ids: a row that has not been taken up takes up its later neighbours that have not been, each once. So of a chain
    a-b, b-c without a-c the rows a and c stay: c's neighbour b is gone when c's turn comes. Rounds settle all rows at once whose earlier neighbours are settled.
    """
    every, gone = written(pairs.select("a", "b").where("a < b").distinct(), "merges"), None
    left = every
    while not left.isEmpty():
        stays = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = written(left.join(stays, "a", "left_semi").select("b").distinct(), "gone")
        gone = now if gone is None else gone.unionByName(now)
        left = written(left.join(now, "b", "left_anti").join(now.select(F.col("b").alias("a")), "a", "left_anti"), "merges")
    # a row that goes in an early round may belong to one that is settled in a later round, so who takes up whom is told at the end
    able = every if gone is None else every.join(gone.select(F.col("b").alias("a")), "a", "left_anti")
    return able.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def consolidated(store: DataFrame, now: Column, decide=None, keys: tuple[str, ...] = ("tenant_id", "user_id"), similar: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The store after duplicates, merges and expiry, and a report (duplicates, merged, expired) in one row.

    Rows that the first step deletes are not merged any more. decide adds merge (boolean) to near pairs (a, b, sim) and, if it likes, content: what a has to say after it has
    taken up b. It is asked about every pair, those of rows with one embedding too, as one pair's decision tells nothing of another's. Which rows are taken up: see merged_into; of several contents for one row that of the largest b counts. Both steps' results are tables.
    """
    deduped = written(without_duplicates(store), "deduped")
    counted = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    out, merged = deduped, deduped.sparkSession.range(1).select(F.lit(0).cast("long").alias("merged"))
    if decide is not None:
        decided = decide(near_pairs(deduped, list(keys), similar)).where("merge")
        decided = written(decided if "content" in decided.columns else decided.withColumn("content", F.lit(None).cast("string")), "decided")
        taken = written(merged_into(decided), "merged")
        said = taken.join(decided.select("a", "b", "content"), ["a", "b"]).where("content is not null").groupBy("a").agg(F.max_by("content", "b").alias("_c"))
        out = out.join(taken.select(F.col("b").alias("memory_id"), F.lit(True).alias("_gone")), "memory_id", "left").join(said.withColumnRenamed("a", "memory_id"), "memory_id", "left")
        out = out.withColumn("status", F.when(F.col("_gone"), 0).otherwise(F.col("status")))
        for name, value in (("content", F.col("_c")), ("content_hash", F.when(F.col("_c").isNotNull(), digest(F.col("_c"))))):
            out = out.withColumn(name, F.coalesce(value, F.col(name))) if name in store.columns else out
        out = written(out.select(*store.columns), "consolidated")
        merged = taken.agg(F.count(F.lit(1)).alias("merged"))
    was = store.agg(counted(F.col("status") == 1, "was"))
    facts = deduped.agg(counted(F.col("status") == 1, "left"), counted(F.col("expires_at") < now, "expired"))
    report = was.join(facts).join(merged).select((F.col("was") - F.col("left")).alias("duplicates"), "merged", "expired")
    return out.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now)), report


def parsed_facts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row a fact of a model's reply: a JSON array, an object with facts, or one object. Short contents (up to 10 characters) are dropped."""
    item = "struct<content: string, type: string, importance: double>"
    raw = unfenced(F.col(reply))
    many, inside, one = F.from_json(raw, f"array<{item}>"), F.from_json(raw, f"struct<facts: array<{item}>>")["facts"], F.from_json(raw, item)
    facts = F.when(raw.startswith("["), many).when(inside.isNotNull(), inside).otherwise(F.array(one))
    rows = replies.withColumn("fact", F.explode(facts)).where(F.length("fact.content") > 10)
    kind = F.upper(F.coalesce("fact.type", F.lit("")))
    return rows.withColumn("content", F.col("fact.content")).withColumn("type", F.when(kind.isin(*TYPES), kind).otherwise("FACT")).withColumn("importance", F.coalesce("fact.importance", F.lit(0.5))).drop("fact")


def parsed_decision(reply: Column) -> Column:
    """struct(action, content): a bad action, or UPDATE or MERGE without content, is KEEP."""
    p = F.from_json(unfenced(reply), "struct<action: string, content: string>")
    action = F.upper(F.coalesce(p["action"], F.lit("")))
    known = F.when(action.isin("UPDATE", "DELETE", "KEEP", "MERGE"), action).otherwise("KEEP")
    empty = p["content"].isNull() | (F.btrim(p["content"]) == "")
    return F.struct(F.when(known.isin("UPDATE", "MERGE") & empty, "KEEP").otherwise(known).alias("action"), p["content"].alias("content"))


def forget_scope(store: DataFrame, tenant: str, user: str, prefix: str) -> DataFrame:
    """Active rows of one owner under a scope get status 0."""
    hit = (F.col("tenant_id") == tenant) & (F.col("user_id") == user) & F.col("scope").startswith(prefix)
    return store.withColumn("status", F.when(hit, 0).otherwise(F.col("status")))


def nightly(store: DataFrame, now: Column, decide=None) -> tuple[DataFrame, DataFrame]:
    """The nightly job over all owners at once: the store after consolidated, and its report with the number of owners with active rows."""
    owners = store.where("status = 1").select("tenant_id", "user_id").distinct().count()
    out, report = consolidated(store, now, decide)
    return out, report.withColumn("owners", F.lit(owners).cast("long"))
