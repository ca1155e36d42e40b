"""License scans: a positional index of license wordings, looked up by their words with the highest idf, intersected by relative position and verified."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What lies between words: ASCII but for digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Wording:
    """A license's wording. keys are phrases of it that must stand, in place or up to `slack` words off; without keys all of it must stand.

    `rare` of its words, those with the highest idf, are looked up; `least` of these must agree on where the wording begins.
    base wordings are found wherever they stand: they have no keys and no slack.
    """

    label: str
    text: str
    keys: tuple[str, ...] = ()
    rare: int = 8
    least: int = 3
    slack: int = 8
    base: bool = field(default=False)

    @property
    def words(self) -> list[str]:
        return self.text.split()


def _phrase(label: str, text: str) -> Wording:
    return Wording(label, text, rare=2, least=2, slack=0, base=True)


# The phrases of the base, and well-known sentences of licenses with what must stand of them.
WORDINGS = (
    _phrase("mit", "under the mit license"),
    _phrase("apache-2", "apache license version 2"),
    _phrase("cc-by-nc", "cc by nc"),
    Wording("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Wording("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    Wording("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",), slack=0),
    Wording("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("redistribute it and or modify it under the terms of the gnu general public license", "version 3 of the license")),
    Wording("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("redistribute it and or modify it under the terms of the gnu general public license", "version 2 of the license")),
    Wording("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1 of the license")),
    Wording("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Wording("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software for any purpose", "is hereby granted provided that the above copyright notice")),
    Wording("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("terms of the mozilla public license v 2 0",)),
    Wording("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international license",)),
    Wording("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    Wording("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Wording("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


def license_words(text: Column) -> Column:
    """The words of a text, A-Z as a-z, null as empty. The Kelvin sign, which lower() would make a k, stays another letter."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))
    return F.array_remove(F.split(low, _BETWEEN), "")


def document_counts(docs: DataFrame, wordings: tuple[Wording, ...] = WORDINGS, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of how many each word of the wordings is in; the latter has at most as many rows as the wordings have words."""
    known = sorted({w for x in wordings for w in x.words})
    own = F.concat(F.array(F.lit("")), F.array_intersect(license_words(F.col(text_col)), F.lit(known)))
    counted = {r.word: r.n for r in docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counted.pop("", 0), counted


def license_index(total: int, counted: dict[str, int], wordings: tuple[Wording, ...] = WORDINGS) -> tuple[list[str], Column]:
    """The looked-up words, and the index as one constant: their postings (wording, position), and of each wording its words, their idf weights and key phrases.

    idf is ln((N + 1) / (n + 1)). Looked up are, for each wording, the positions of its words with the highest idf among those that any document has,
    first positions first. A wording with a key word that no document has stands in none, so none of its words is looked up.
    """
    from math import log

    weight = {w: round(log((total + 1) / (counted.get(w, 0) + 1)), 6) for x in wordings for w in x.words}
    postings: dict[str, list] = {}
    for t, x in enumerate(wordings):
        possible = all(counted.get(w) for k in x.keys or (x.text,) for w in k.split())
        seen = sorted((-weight[w], q) for q, w in enumerate(x.words) if counted.get(w)) if possible else []
        for _, q in seen[: x.rare]:
            postings.setdefault(x.words[q], []).append({"t": t, "q": q})
    keys = [[{"o": _place(x.words, k.split()), "w": k.split()} for k in x.keys or (x.text,)] for x in wordings]
    rows = [{"label": x.label, "base": x.base, "least": x.least, "slack": x.slack, "words": x.words, "weights": [weight[w] for w in x.words], "keys": k} for x, k in zip(wordings, keys, strict=True)]
    wording = "struct<label: string, base: boolean, least: int, slack: int, words: array<string>, weights: array<double>, keys: array<struct<o: int, w: array<string>>>>"
    schema = f"struct<postings: map<string, array<struct<t: int, q: int>>>, wordings: array<{wording}>>"
    return sorted(postings), F.from_json(F.lit(json.dumps({"postings": postings, "wordings": rows})), schema)


def _place(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def license_places(words: Column, asked: list[str], index: Column) -> Column:
    """array<struct<label, base, start, score>>: where wordings stand among words. start counts words from 0 and may be negative if the beginning is missing.

    Every looked-up word's places vote for the beginnings that its postings tell; sorted votes show in one pass which beginnings have enough. At these the
    key phrases are compared word by word. score is the share of the wording's idf that stands exactly in place (1 for a whole one).
    """
    kind = "array<struct<label: string, base: boolean, start: bigint, score: double>>"
    if not asked:
        return F.array().cast(kind)
    wordings, postings = index["wordings"], index["postings"]
    every = F.when(F.arrays_overlap(words, F.lit(asked)), F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(every, lambda p: F.get(words, p).isin(asked))
    votes = F.flatten(F.transform(hits, lambda p: F.transform(F.try_element_at(postings, F.get(words, p)), lambda x: F.struct(x["t"].alias("t"), (p - x["q"]).alias("s")))))
    of = lambda x: F.get(wordings, x["t"])
    first = lambda v, x, i: (i == 0) | (F.get(v, i - 1) != x)
    agreed = _let(F.array_sort(votes), lambda v: F.filter(v, lambda x, i: first(v, x, i) & F.coalesce(F.get(v, i + of(x)["least"] - 1) == x, F.lit(False))))

    def stands(x: Column, k: Column) -> Column:
        at = lambda d: x["s"] + k["o"] + d
        return F.exists(F.sequence(-of(x)["slack"], of(x)["slack"]), lambda d: F.when(at(d) >= 0, F.slice(words, at(d) + 1, F.size(k["w"])) == k["w"]).otherwise(False))

    def score(x: Column) -> Column:
        w = of(x)
        matched = F.aggregate(F.sequence(F.lit(0), F.size(w["words"]) - 1), F.lit(0.0), lambda s, q: s + F.when(F.get(words, x["s"] + q) == F.get(w["words"], q), F.get(w["weights"], q)).otherwise(0.0))
        whole = F.aggregate(w["weights"], F.lit(0.0), lambda s, y: s + y)
        return F.when(whole > 0, F.round(matched / whole, 6)).otherwise(F.when(of(x)["base"], 1.0).otherwise(0.0))

    verified = F.filter(agreed, lambda x: F.forall(of(x)["keys"], lambda k: stands(x, k)))
    return F.transform(verified, lambda x: F.struct(of(x)["label"].alias("label"), of(x)["base"].alias("base"), x["s"].cast("long").alias("start"), score(x).alias("score"))).cast(kind)


def base_places(places: Column) -> Column:
    return F.filter(places, lambda p: p["base"])


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def license_scan(docs: DataFrame, wordings: tuple[Wording, ...] = WORDINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places) of every whole text, in two passes: counts of the wordings' words over all documents, then each text by itself, without a shuffle.

    places: see license_places. A phrase of the base is found wherever it stands, as all its words are there and so are those looked up. A longer
    wording is found if `least` of its `rare` looked-up words stand in place and so do its key phrases, give or take `slack` words.

    A null text is empty and has no words. Rows are taken one by one: repeated ids and null ids too. Without documents there is no row. Of equally
    rare words the one that stands first is looked up. A text of any length is one row in one task.
    """
    total, counted = document_counts(docs, wordings, text_col)
    asked, index = license_index(total, counted, wordings)
    own = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    return own.select("doc_id", F.size("words").cast("long").alias("n_words"), license_places(F.col("words"), asked, index).alias("places"))
