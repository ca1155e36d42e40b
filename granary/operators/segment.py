"""Words of texts that are written without spaces: a lexicon learnt from the texts, and the likeliest cut of each run of ideographs by it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Runs that are cut into words.
IDEOGRAPHS = "[一-鿿]+"


def learnt(docs: DataFrame, text_col: str = "text", alphabet: str = IDEOGRAPHS, longest: int = 4, least: int = 5, cohesion: float = 2.0, freedom: float = 0.8, most: int = 200_000) -> DataFrame:
    """(word, n, weight): single letters, and groups of up to `longest` that occur `least` times, hold together and stand freely; the `most` most frequent ones.

    A group holds together if it is e^cohesion times as frequent as either of its cuts would be by chance. It stands freely if what comes before it, and what comes behind, varies: the
    entropy of the neighbours is at least `freedom` on both sides; the end of a run is a neighbour of its own each time. weight is ln(n / letters).
    All counts are aggregations that each task begins on its own, so a frequent letter is a row a task.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(alphabet), F.lit(0))).alias("r"))
    at = lambda i, n: F.substring("r", i, n)
    group = lambda i, n: F.struct(at(i, n).alias("word"), F.when(i > 1, at(i - 1, F.lit(1))).alias("before"), F.when(i + n <= F.length("r"), at(i + n, F.lit(1))).alias("behind"))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.length("r")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("r") - i + 1)), lambda n: group(i, n))))
    groups = runs.where("r <> ''").select(F.explode(every).alias("g")).select("g.*")
    counts = written(groups.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | (F.length("word") == 1)), "groups")
    letters = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    longer = counts.where(F.length("word") > 1)

    cuts = longer.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.length("word")).alias("b"))
    parts = cuts.join(counts.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    held = parts.groupBy("word").agg(F.min(F.log(F.col("n") * F.lit(float(letters)) / (F.col("na") * F.col("nb")))).alias("cohesion")).where(F.col("cohesion") >= cohesion)

    def varied(side: str) -> DataFrame:
        c = groups.join(held.select("word"), "word", "left_semi").groupBy("word", side).agg(F.count(F.lit(1)).alias("c"))
        entropy = F.log(F.sum("c")) - F.sum(F.when(F.col(side).isNotNull(), F.col("c") * F.log("c")).otherwise(0.0)) / F.sum("c")
        return c.groupBy("word").agg(entropy.alias("h")).where(F.col("h") >= freedom).select("word")

    words = longer.join(varied("before"), "word", "left_semi").join(varied("behind"), "word", "left_semi").unionByName(counts.where(F.length("word") == 1))
    return words.orderBy(F.desc("n"), "word").limit(most).withColumn("weight", F.log(F.col("n") / F.lit(float(max(letters, 1)))))


def best_cut(run: str, weights: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of a run with the largest sum of weights; of equal ones the cut with the fewer words, then the one whose first different word is longer. Letters without a weight have `unknown`."""
    n = len(run)
    # of what is left from each place: its sum, its words (counted down) and the first one's length
    tail = {n: (0.0, 0, 0)}
    for i in range(n - 1, -1, -1):
        best = []
        for size in range(1, min(longest, n - i) + 1):
            w = weights.get(run[i : i + size], unknown if size == 1 else None)
            if w is not None:
                rest = tail[i + size]
                best.append((round(w + rest[0], 9), -1 + rest[1], size))
        tail[i] = max(best)
    out, i = [], 0
    while i < n:
        out.append(run[i : i + tail[i][2]])
        i += tail[i][2]
    return out


def segmented(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", alphabet: str = IDEOGRAPHS) -> DataFrame:
    """docs with spaces around the words of each run, for an index whose analyser splits at spaces (see index.keyword_index and spaced).

    The lexicon is a bounded table (see learnt: most) that goes to every task. A null text stays null.
    """
    rows = lexicon.select("word", "weight").toArrow().to_pydict()
    weights = dict(zip(rows["word"], rows["weight"], strict=True))
    longest, unknown = max(map(len, weights), default=1), min(weights.values(), default=0.0) - math.log(2)
    columns = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaced_out = re.compile(alphabet)
        for pdf in batches:
            said = [spaced_out.sub(lambda m: " " + " ".join(best_cut(m[0], weights, longest, unknown)) + " ", t) if isinstance(t, str) else None for t in pdf[text_col]]
            yield pdf.assign(**{text_col: said})[columns]

    return docs.mapInPandas(run, docs.schema)


def spaced(text: Column) -> Column:
    """Lower-cased words of a segmented text: runs of letters and digits, ideographs among them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")
