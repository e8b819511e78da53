"""Licence scans by a positional rare-token index; DataFrame operations only.

Notices are templates; each of their words has an inverse document frequency over the templates and
postings (template, place). Of the licence words that a file holds, those of highest weight are looked
up, `rare` of each template; a template whose looked-up words have too few places is out. Each place
in the file votes for its place in the file less the place in the template; the notice is where the
votes of enough places lie within `2 * drift` of each other, found by one sweep over the sorted
votes, and where all the template's mandatory phrases stand within it. Of equally good places the
first is reported. Everything is a narrow map over rows: files without a word that some notice must
hold never build arrays.

Only A-Z are lower-cased. Nulls are empty texts, which hold nothing. Ids may be null or repeat; rows
are scanned each for itself, and an empty table gives no rows. Other columns are ignored. A very long
text costs time and memory in proportion to its words.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"  # what GAP leaves of lower-cased text

# Base phrases and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Notices, each with its label and its mandatory phrases.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "this software and associated documentation files")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
]


class Index:
    """Words of each template by falling weight, and their places in it."""

    def __init__(self, templates=TEMPLATES, rare: int = 8):
        self.rare = rare
        self.templates = [(label, text.split(), [p.split() for p in phrases]) for label, text, phrases in templates]
        if max(len(words) for _, words, _ in self.templates) > 63:
            raise ValueError("a template has 63 words at most, one for each bit of a number")
        df: dict[str, int] = {}
        for _, words, _ in self.templates:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: math.log((1 + len(self.templates)) / (1 + n)) for w, n in df.items()}
        self.ranked, self.places, self.indexed = [], [], []
        for _, words, _ in self.templates:
            ranked = sorted(set(words), key=lambda w: (-self.idf[w], w))
            places = {w: [i for i, x in enumerate(words) if x == w] for w in ranked}
            self.ranked.append(ranked)
            self.places.append(places)
            self.indexed.append(sum(len(places[w]) for w in ranked[:rare]))


def _phrase_at(words: Column, phrase: list[str], i: Column) -> Column:
    return reduce(and_, [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)])


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when((w == phrase[0]) & _phrase_at(words, phrase, i), i)), lambda p: p.isNotNull())


def _hint(text: Column, phrases: list[list[str]]) -> Column:
    """What a text that holds all phrases holds: their longest word, or a phrase of short words."""
    word = max((w for p in phrases for w in p), key=len)
    if len(word) > 4:
        return F.contains(text, F.lit(word))
    return F.contains(text, F.lit(phrases[0][0])) & text.rlike(GAP.join(phrases[0]))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. `lower` changes other letters too, which no phrase holds, but for the two
    that it turns into ASCII letters; texts with those take the slower way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[\u0130\u212a]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None, agree: float = 0.75, drift: int = 2) -> DataFrame:
    """One row per input row: id, n_words, base (array of start, label), notices (array of label,
    start, share of as many places as the template's rarest words have)."""
    index = index or Index()
    low = ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    df = docs.select(docs[id_col].alias("__id"), low.alias("__t"))
    hint = reduce(or_, [_hint(F.col("__t"), phrases) for _, _, phrases in index.templates] + [F.contains("__t", F.lit("license"))])
    no_words = F.array().cast("array<string>")
    words = F.when(hint, F.array_remove(F.split("__t", GAP), "")).otherwise(no_words)
    df = df.select("__id", F.regexp_count("__t", F.lit(WORD)).cast("long").alias("n_words"), words.alias("__w"))

    def label_all(starts: Column, label: str) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))

    base = F.concat(*[label_all(phrase_starts(F.col("__w"), p.split()), label) for label, p in BASE.items()])
    vocabulary = F.array(*[F.lit(w) for w in sorted(index.idf)])
    placed = F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(vocabulary, x["w"]))
    df = df.withColumn("__base", base).withColumn("__placed", placed)
    df = df.withColumn("__present", F.array_distinct(F.transform("__placed", lambda x: x["w"])))
    empty = F.array().cast("array<struct<label:string,start:int,share:double>>")

    width = 2 * drift
    lits = lambda xs: F.array(*map(F.lit, xs))

    def entry(t: int) -> Column:
        label, text, phrases = index.templates[t]
        places = F.create_map(*[x for w in index.ranked[t] for x in (F.lit(w), lits(index.places[t][w]))])
        fields = {"label": F.lit(label), "length": F.lit(len(text)), "indexed": F.lit(index.indexed[t]), "need": F.lit(math.ceil(agree * index.indexed[t]))}
        return F.struct(*[c.alias(n) for n, c in fields.items()], lits(index.ranked[t]).alias("ranked"), places.alias("places"), F.array(*map(lits, phrases)).alias("phrases"))

    def votes(t: Column, own: Column) -> Column:
        """(start of the template, a bit for the place in it) of each place in the file of the words `own`."""
        rare = F.filter("__placed", lambda x: F.array_contains(own, x["w"]))
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
        each = F.transform(rare, lambda x: F.transform(F.element_at(t["places"], x["w"]), lambda p: F.struct((x["i"] - p).alias("at"), bit(p).alias("bit"))))
        return F.array_sort(F.flatten(each))

    def swept(t: Column, v: Column) -> Column:
        """The best window of the sorted votes: (agreeing places, negative start). A window has one vote
        of each template place at each start at most."""

        def window(x: Column, k: Column) -> Column:
            first = F.coalesce(F.get(v, k - 1)["at"] != x["at"], F.lit(True))
            near = F.slice(v, k + 1, (width + 1) * t["length"])
            bits = F.aggregate(near, F.lit(0).cast("long"), lambda a, y: F.when(y["at"] <= x["at"] + width, a.bitwiseOR(y["bit"])).otherwise(a))
            return F.when(first, F.struct(F.bit_count(bits).alias("n"), (-x["at"]).alias("before")))

        return F.array_max(F.transform(v, window))

    def judged(t: Column, best: Column) -> Column:
        start = -best["before"]
        around = F.sequence(F.greatest(F.lit(0), start - width), F.greatest(F.lit(0), start) + t["length"] + width)
        inside = F.forall(t["phrases"], lambda p: F.exists(around, lambda i: F.slice("__w", i + 1, F.size(p)) == p))
        share = F.least(F.lit(1.0), best["n"] / t["indexed"])
        return F.when((best["n"] >= t["need"]) & inside, F.struct(t["label"].alias("label"), start.cast("int").alias("start"), share.alias("share")))

    def notice(t: Column) -> Column:
        # the file's words of highest weight among the template's, in order of weight
        chosen = F.slice(F.array_intersect(t["ranked"], F.col("__present")), 1, index.rare)
        possible = lambda own: F.aggregate(own, F.lit(0), lambda a, w: a + F.size(F.element_at(t["places"], w)))
        search = lambda own: F.when(possible(own) >= t["need"], _let(_let(votes(t, own), lambda v: swept(t, v)), lambda b: judged(t, b)))
        return _let(chosen, search)

    every = F.array(*[entry(t) for t in range(len(index.templates))])
    found = F.filter(F.transform(every, notice), lambda x: x.isNotNull())
    notices = F.when(F.size("__present") > 0, found).otherwise(empty)
    return df.select(F.col("__id").alias(id_col), "n_words", F.col("__base").alias("base"), notices.alias("notices"))


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. score: 1 with a base phrase, else the best notice's share, else 0."""
    s = scan(docs)
    starts = F.transform("base", lambda b: b["start"])
    own = F.transform("base", lambda b: b["label"])
    more = F.transform("notices", lambda n: n["label"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    return s.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        join(own).alias("base_labels"),
        join(F.concat(own, more)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
        join(more).alias("notice_labels"),
    )
