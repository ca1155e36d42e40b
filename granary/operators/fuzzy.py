"""Terms within an edit distance of query words: a sorted dictionary is walked as a trie, and a branch is left as soon as no word can come of it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import Postings, query_terms
from .retrieve import in_blocks
from .tables import written


def automatic(length: int) -> int:
    """The edit distance that a word of a length may have: 0 up to two letters, 1 up to five, else 2."""
    return 0 if length <= 2 else 1 if length <= 5 else 2


def within(terms: list[str], word: str, allowed: int) -> list[tuple[int, int]]:
    """(place, distance) of the sorted terms at a distance of at most `allowed`; an edit inserts, deletes or replaces a letter or swaps two neighbours.

    Terms with a common prefix share its rows of distances. Letters between two swapped ones may be edited as well, which costs their number, so a row can be reached from
    earlier ones than the last; a branch is left when none of its rows can lead to a distance that is allowed.
    """
    m, found = len(word), []
    rows: list[list[int]] = [list(range(m + 1))]
    last: list[dict[str, int]] = [{}]  # for each depth, where a letter of the path stood last (its row)

    def row_of(letter: str, depth: int) -> list[int]:
        above, seen, match = rows[depth - 1], last[depth - 1], 0
        row = [depth] + [0] * m
        for j in range(1, m + 1):
            c = word[j - 1]
            best = above[j - 1] + (c != letter)
            if above[j] + 1 < best:
                best = above[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            k = seen.get(c, 0)
            if k and match:
                swapped = rows[k - 1][match - 1] + (depth - k - 1) + 1 + (j - match - 1)
                if swapped < best:
                    best = swapped
            if c == letter:
                match = j
            row[j] = best
        return row

    def walk(low: int, high: int, depth: int) -> None:
        """Terms low to high share their first `depth` letters, whose rows are known."""
        while low < high and len(terms[low]) == depth:
            if rows[depth][m] <= allowed:
                found.append((low, rows[depth][m]))
            low += 1
        while low < high:
            letter = terms[low][depth]
            after = chr(ord(letter) + 1) if letter < "\U0010ffff" else None
            end = bisect_left(terms, terms[low][:depth] + after, low, high) if after is not None else high
            del rows[depth + 1 :], last[depth + 1 :]
            rows.append(row_of(letter, depth + 1))
            last.append({**last[depth], letter: depth + 1})
            if any(min(rows[r]) + (depth + 1 - r) <= allowed for r in range(max(0, depth + 1 - allowed), depth + 2)):
                walk(low, end, depth + 1)
            low = end

    walk(0, len(terms), 0)
    return found


def expansions(dictionary: DataFrame, words: DataFrame, most: int = 50) -> DataFrame:
    """(asked, term, distance, boost): for each of words (term, a bounded number) the terms of dictionary (term) at an automatic distance.

    boost = 1 - distance / the shorter length; of a word's terms the `most` with the largest boosts count, equal ones in the order of terms. Sorted files of the dictionary make the walks short.
    """
    asked = sorted(r.term for r in words.select("term").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = sorted(b.column("term").to_pylist())
            rows = [(w, terms[i], d) for w in asked for i, d in within(terms, w, automatic(len(w)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["asked", "term", "distance"])

    near = dictionary.select("term").where("term is not null").mapInArrow(run, "asked string, term string, distance int")
    boosted = near.withColumn("boost", F.lit(1.0) - F.col("distance") / F.least(F.length("asked"), F.length("term"))).where("boost > 0")
    w = Window.partitionBy("asked").orderBy(F.desc("boost"), "term")
    return boosted.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def fuzzy_query_terms(index: Postings, most: int = 50):
    """For a search over an index: from queries to (query_id, term, boost) with the terms near to each word; a term that several words lead to has the sum of their boosts."""

    def terms(queries: DataFrame) -> DataFrame:
        def block(some: DataFrame) -> DataFrame:
            words = written(some.select("query_id", F.col("term").alias("asked")), "words")
            near = expansions(index.lexicon, words.select(F.col("asked").alias("term")), most)
            return near.join(F.broadcast(words), "asked").groupBy("query_id", "term").agg(F.sum("boost").alias("boost"))

        return in_blocks(query_terms(queries), block)

    return terms
