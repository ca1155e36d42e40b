"""Windows and budgets: the last messages, replay plans, bounded texts, capped lists and thinned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank

# Marks that tell a reader that something was cut.
OMITTED = "\n...[历史回复中段省略 {n} 字符]...\n"
SPILLED = "\n[spill] 结果超限已截断：原始 {n} 字符，预算 {most} 字符。数据可能不完整，如需完整数据请缩小查询范围或增大步长。"


def last_messages(messages: DataFrame, session: str, order: Sequence[str], n: int = 12) -> DataFrame:
    """The newest n messages of each session."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def head_and_tail(text: Column, limit: int = 2000) -> Column:
    """A long text by 60 % of its head and 40 % of its tail, with a mark that tells how much is left out; 64 characters are kept for the mark."""
    keep = limit - 64
    head = int(keep * 0.6)
    tail = keep - head
    before, after = OMITTED.split("{n}")
    mark = F.concat(F.lit(before), (F.length(text) - keep).cast("string"), F.lit(after))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), mark, F.right(text, F.lit(tail))))


def spill_bound(text: Column, most: int = 6000) -> Column:
    """A prefix and a mark, `most` characters in all, for a text that is longer."""
    a, b, c = SPILLED.replace("{most}", str(most)).partition("{n}")[0], "", SPILLED.replace("{most}", str(most)).partition("{n}")[2]
    mark = F.concat(F.lit(a + b), F.length(text).cast("string"), F.lit(c))
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(F.lit(most) - F.length(mark), F.lit(0))), mark)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def replay_plan(records: DataFrame, session: str, order: Sequence[str], most: int = 6, budget: int = 8000, answer_limit: int = 2000) -> DataFrame:
    """(session, *order, question, answer, cost, position, capped): what is replayed of each session's newest records.

    From the newest on, a record counts its question and its bounded answer; blank ones are left out and records without either are free
    and dropped. The first record that passes the budget ends the plan, but the newest one that says something always stays.
    position is oldest first; capped tells that records were left out for the budget.
    """
    newest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    rows = records.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= most)
    rows = rows.withColumn("question", F.when(~blank(F.col("question")), F.col("question")))
    rows = rows.withColumn("answer", F.when(~blank(F.col("answer")), head_and_tail(F.col("answer"), answer_limit)))
    cost = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))
    rows = rows.withColumn("cost", cost).where("question is not null or answer is not null")
    w = Window.partitionBy(session).orderBy("_i")
    rows = rows.withColumn("_sum", F.sum("cost").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    # costs are positive, so sums grow: the first record over the budget and all older ones go
    inside = F.col("_first") | (F.col("_sum") <= budget)
    everything = Window.partitionBy(session)
    rows = rows.withColumn("capped", F.max(~inside).over(everything)).where(inside)
    rows = rows.withColumn("position", (F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_i"))) - 1).cast("long"))
    return rows.select(session, *order, "question", "answer", F.col("cost").cast("long").alias("cost"), "position", "capped")


def capped(rows: DataFrame, order: Sequence[Column], n: int, group: str | None = None) -> DataFrame:
    """The first n rows (of each group), with the true total and whether rows were left out."""
    keys = [group] if group else [F.lit(0)]
    total = rows.groupBy(*([group] if group else [])).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
    joined = first.join(F.broadcast(total) if not group else total, [group] if group else [], "inner") if group else first.withColumn("total", total.scalar())
    return joined.withColumn("spilled", F.col("total") > n)


def spill_note(kind: str, most: int) -> Column:
    """The note beside a capped list: kind 'alerts' or 'logs'; null where nothing was left out."""
    # Texts of the notes.
    notes = {"alerts": "[spill] 活动告警共 %d 条，超出单次返回上限 %d 条，仅保留前 %d 条（含最高优先触发顺序）；如需其余告警请分批查询。", "logs": "[spill] 匹配日志共 %d 条，超出单次返回上限 %d 条，仅保留最近 %d 条（时间倒序）；如需更早日志请缩小时间范围或提高过滤精度。"}
    return F.when(F.col("spilled"), F.format_string(notes[kind], F.col("total"), F.lit(most), F.lit(most)))


def downsampled(points: DataFrame, series: str, order: Sequence[str], most: int = 120, spans: int = 64) -> DataFrame:
    """Series of over `most` points thinned to evenly spaced ones, the first and last among them; point is the new index.

    Points are numbered in `spans` equal spans of the first order column (a number, date or time) and moved on by the points of the spans
    before, so that a series with very many points is not one task; with an order column of another kind it is.
    """
    kind = dict(points.dtypes)[order[0]]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp") or kind.startswith("decimal"):
        at = F.col(order[0]).cast("double")
    elif kind == "timestamp_ntz":
        # as it stands, without a time zone that could turn hours back
        t = F.col(order[0])
        at = F.unix_date(t.cast("date")) * F.lit(86400.0) + F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")
    else:
        at = F.unix_date(order[0]).cast("double") if kind == "date" else F.lit(0.0)
    facts = points.groupBy(F.col(series).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    rows = points.join(facts, F.col(series).eqNullSafe(F.col("_s"))).drop("_s")
    # the same order as the column's: nulls first; all in one span where the ends have no distance
    place = F.floor(F.nanvl((at - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0)) * spans)
    rows = rows.withColumn("_span", F.when(at.isNull(), -1).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(spans - 1)))).drop("_lo", "_hi")
    sizes = rows.groupBy(F.col(series).alias("_s"), F.col("_span").alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sizes.select("_s", "_t", F.coalesce(before, F.lit(0)).alias("_before")), F.col(series).eqNullSafe(F.col("_s")) & (F.col("_span") == F.col("_t")))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(series, "_span").orderBy(*order)) - 1 + F.col("_before")).drop("_s", "_t", "_before", "_span")
    short = rows.where(F.col("_n") <= most).withColumn("point", F.col("_i").cast("long"))
    # of the points that a row can be, the one whose rounded place it is
    long_ = rows.where(F.col("_n") > most)
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    guess = F.floor(F.col("_i") / step)
    places = F.transform(F.array(guess - 1, guess, guess + 1), lambda p: F.struct(p.alias("p"), F.when(p == 0, F.lit(0)).when(p == most - 1, F.col("_n") - 1).otherwise(F.floor(p * step + 0.5)).alias("at")))
    mine = F.filter(places, lambda x: (x["p"] >= 0) & (x["p"] < most) & (x["at"] == F.col("_i")))
    thinned = long_.withColumn("_p", F.get(mine, F.lit(0))["p"]).where("_p is not null").withColumn("point", F.col("_p").cast("long")).drop("_p")
    return short.unionByName(thinned).drop("_n", "_i")


def tool_call_log(calls: DataFrame, session: str, order: Sequence[str], most: int = 500) -> DataFrame:
    """calls (input, output) with both cut to `most` characters and numbered in each session."""
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(F.col(c))
    w = Window.partitionBy(session).orderBy(*order)
    return calls.withColumn("input", cut("input")).withColumn("output", cut("output")).withColumn("order_no", F.row_number().over(w))


def stream_cap(text: Column, most: int = 16384) -> Column:
    return F.substring(text, 1, most)
