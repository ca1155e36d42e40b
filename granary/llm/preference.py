"""Preference pairs: the longest common turn prefix as prompt, and masked completions of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .imatch import with_next

#: How a turn is written.
TURN = ("<|{role}|>\n", "\n<|end|>\n")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as array<struct(turn, role, text)>.

    Turns are ordered by number, then role and text; null roles and texts count as empty, a null
    number comes first; a turn that is there twice is kept twice; rows without conv_id are left out.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))


def _written(turns: Column, trained: bool) -> Column:
    """array<struct(text, loss)> of turns: the header never counts for the loss, an assistant's text and end do if trained."""
    head, end = TURN
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(head.split("{role}")[0]), t["role"], F.lit(head.split("{role}")[1])).alias("text"), F.lit(0).alias("loss")),
                F.struct(F.concat(t["text"], F.lit(end)).alias("text"), F.when((t["role"] == "assistant") & F.lit(trained), 1).otherwise(0).alias("loss")),
            ),
        )
    )


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def _mask(parts: Column) -> Column:
    """Runs of the mask over characters: 'length:loss' joined by commas."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.length(p["text"]), p["loss"])), ",")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) for pairs with the turn arrays of both.

    n_common is the length of the longest common prefix of turns (equal role and text). The prompt is
    that prefix, rendered once; chosen and rejected are what follows on each side, with masks that train on
    assistant turns only. Where one side is a prefix of the other (or both are equal) its completion is empty.
    """
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    size = F.least(F.size(a), F.size(b))
    differs = F.filter(F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, size), lambda x, i: F.when((x["a"]["role"] != x["b"]["role"]) | (x["a"]["text"] != x["b"]["text"]), i)), lambda x: x.isNotNull())
    rows = pairs.withColumn("n_common", F.coalesce(F.get(differs, F.lit(0)), size))
    n = F.col("n_common")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    rows = rows.select("chosen_id", "rejected_id", n.cast("long").alias("n_common"), _joined(_written(F.slice(a, 1, n), False)).alias("prompt"), _written(rest(a), True).alias("c"), _written(rest(b), True).alias("r"))
    return rows.select("chosen_id", "rejected_id", "n_common", "prompt", _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def pair_by_opening(convs: DataFrame, width: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(pairs (chosen_id, rejected_id), alone (conv_id)) of conversations with the same first turn, each conversation in one pair at most.

    The conversations of one opening are numbered by id, and the first and second, third and fourth and so on are paired, so
    of an opening at most one stays alone. Numbers come from those inside ranges of `width` ids and the counts of the ranges before, so a
    frequent opening is spread over tasks. Chosen is the one with more turns, then the smaller id.
    """
    first = F.get("turns", F.lit(0))
    opening = F.md5(F.concat(first["role"], F.lit("\x1f"), first["text"]).cast("binary"))
    heads = cut(convs.select("conv_id", opening.alias("opening"), F.size("turns").alias("n"), F.floor(F.col("conv_id") / width).cast("long").alias("range")))
    before = Window.partitionBy("opening").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.groupBy("opening", "range").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).select("opening", "range", "before")
    lined = heads.withColumn("i", F.row_number().over(Window.partitionBy("opening", "range").orderBy("conv_id"))).join(offsets, ["opening", "range"])
    member = F.struct("conv_id", "n")
    couples = lined.groupBy("opening", F.floor((F.col("i") + F.col("before") + 1) / 2).alias("couple")).agg(F.min(member).alias("a"), F.max(member).alias("b"), F.count(F.lit(1)).alias("c"))
    couples = cut(couples)
    a, b = F.col("a.conv_id"), F.col("b.conv_id")
    ahead = F.col("a.n") >= F.col("b.n")
    pairs = couples.where("c = 2").select(F.when(ahead, a).otherwise(b).alias("chosen_id"), F.when(ahead, b).otherwise(a).alias("rejected_id"))
    return pairs, couples.where("c = 1").select(a.alias("conv_id"))


def with_foreign_replies(convs: DataFrame) -> DataFrame:
    """Pairs with turn arrays where only conversations are given: each one's last reply against a foreign one.

    chosen is a conversation up to its last assistant turn; rejected has in its place the last reply of the next such
    conversation by descending id (after the last: the first), whose id is rejected_id. Conversations without a reply are left out.
    """
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    known = convs.withColumn("at", at).where("at is not null").select("conv_id", F.slice("turns", 1, F.col("at") + 1).alias("turns"))
    replies = with_next(known.select("conv_id", F.element_at("turns", -1)["text"].alias("reply"), F.col("conv_id").alias("of")), ["reply", "of"], "conv_id")
    both = known.join(replies.select("conv_id", "next_reply", "next_of"), "conv_id")
    own = F.element_at("turns", -1)
    other = F.struct(own["turn"].alias("turn"), own["role"].alias("role"), F.col("next_reply").alias("text"))
    rejected = F.concat(F.slice("turns", 1, F.size("turns") - 1), F.array(other))
    return both.select(F.col("conv_id").alias("chosen_id"), F.col("next_of").alias("rejected_id"), F.col("turns").alias("chosen_turns"), rejected.alias("rejected_turns"))


def preference_format(turns: DataFrame, pairs: DataFrame | None = None, foreign: bool = False) -> DataFrame:
    """Preference rows (see preference_rows) of `pairs` (chosen_id, rejected_id) of conversations.

    Without pairs, those of pair_by_opening; with foreign also, for each conversation that has no mate, its own last reply against a foreign one
    (see with_foreign_replies). Pairs with an id that has no turns, or a null id, are left out; repeated pairs
    are returned as often; null texts and roles count as empty; turns without conv_id are left out; repeated turns are kept; an empty table gives none; texts
    of any length are written whole; columns of turns other than conv_id, turn, role and text are ignored.
    """
    convs = cut(conversations(turns.select("conv_id", "turn", "role", "text")))
    alone = None
    if pairs is None:
        pairs, alone = pair_by_opening(convs)
    a = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    b = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    both = pairs.select("chosen_id", "rejected_id").join(a, "chosen_id").join(b, "rejected_id")
    if foreign and alone is not None:
        made = with_foreign_replies(convs).join(alone.select(F.col("conv_id").alias("chosen_id")), "chosen_id", "left_semi")
        both = both.unionByName(made.select(*both.columns))
    return preference_rows(both)
