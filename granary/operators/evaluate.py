"""Answer quality, parsed scores, guarded model calls, routing, prompts, token cost and reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overall(faithful: Column, relevant: Column, hallucinated: Column) -> Column:
    return F.round(0.4 * faithful + 0.4 * relevant + 0.2 * (1 - hallucinated), 6)


def acceptable(score: Column, hallucinated: Column, least: float = 0.6, most: float = 0.3) -> Column:
    return (score >= least) & (hallucinated < most)


def answer_quality(rows: DataFrame, enabled: bool = True) -> DataFrame:
    """rows (faithful, relevant, hallucinated) with overall and acceptable; 1.0 and true where evaluation is off."""
    if not enabled:
        return rows.withColumn("overall", F.lit(1.0)).withColumn("acceptable", F.lit(True))
    scored = rows.withColumn("overall", overall(F.col("faithful"), F.col("relevant"), F.col("hallucinated")))
    return scored.withColumn("acceptable", acceptable(F.col("overall"), F.col("hallucinated")))


def score_of(reply: Column) -> Column:
    """The first number of a reply without its sign, between 0 and 1; 0.5 without one."""
    n = F.regexp_extract(F.coalesce(reply, F.lit("")), r"\d+(\.\d+)?", 0).try_cast("double")
    return F.when(n.isNull(), 0.5).otherwise(F.least(n, F.lit(1.0)))


def hallucination_of(reply: Column) -> Column:
    """The number after the label of the hallucinated share, else as score_of; 0 without a reply."""
    n = F.regexp_extract(F.coalesce(reply, F.lit("")), r"幻觉比例[:：]\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(reply.isNull(), 0.0).otherwise(F.when(n.isNotNull(), F.least(n, F.lit(1.0))).otherwise(score_of(reply)))


def guarded(call: Callable[[], str | None], tries: int = 3, most: int = 500, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first valid reply, trimmed: not blank and at most `most` characters. None after `tries`.

    After an exception the next try waits, twice as long each time; an invalid reply is tried again at once.
    """
    for i in range(tries):
        try:
            reply = call()
        except Exception:  # noqa: BLE001  any failure of a model counts as a try
            if i + 1 < tries:
                sleep(delay)
                delay *= 2
            continue
        text = (reply or "").strip()
        if text and len(text) <= most:
            return text
    return None


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, prompt, completion) with cost; unknown models cost 0 and rows without tokens are left out."""
    priced = usage.where("prompt > 0 or completion > 0").join(prices, "model", "left")
    cost = F.col("prompt") / 1000 * F.col("input_per_1k") + F.col("completion") / 1000 * F.col("output_per_1k")
    return priced.withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6)).select(*usage.columns, "cost")


def routed(primary: str | None, fallbacks: Sequence[str | None] = (), default: str | None = None) -> list[str]:
    """Models in the order to try: the primary, else the default, then distinct fallbacks that are not blank."""
    own = [m for m in (primary if primary and primary.strip() else default, *fallbacks) if m and m.strip()]
    return list(dict.fromkeys(own))


class Prompts:
    """Versioned prompts; the highest version of a name is current."""

    def __init__(self):
        self._all: dict[str, dict[int, str]] = {}

    def register(self, name: str, version: int, text: str) -> None:
        own = self._all.setdefault(name, {})
        if own.get(version, text) != text:
            raise ValueError(f"{name} has another text in version {version}")
        own[version] = text

    def get(self, name: str, version: int | None = None) -> str:
        own = self._all[name]
        return own[max(own) if version is None else version]


def retrieval_report(hits: DataFrame) -> DataFrame:
    """A row a query: number of hits, whether there is none, and hits with scores as JSON; a null score is 0."""
    item = F.struct("rank", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    n = F.count("id")
    return hits.groupBy("query_id").agg(n.alias("count"), (n == 0).alias("empty"), F.to_json(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), item)))).alias("hits_json"))


def failure_kind(status: Column, body: Column) -> Column:
    """Kind of a provider's failure by HTTP status and reply."""
    quota = F.lower(F.coalesce(body, F.lit(""))).contains("quota")
    return F.when((status == 429) & quota, "QUOTA").when(status == 429, "RATE_LIMITED").when(status.isin(401, 403), "AUTH").when(status >= 500, "PROVIDER").otherwise("UNKNOWN")
