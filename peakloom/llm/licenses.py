"""License scan as an exact set-similarity join of word blocks with templates; DataFrame functions only.

Blocks are windows of 64 words, one every 32, so that any 33 words in a row stand in one of them; longer templates make them wider. A block meets a
template if it holds at least ``threshold`` of the template's distinct words.

1. One pass over the texts writes, for each row, its base columns and its words of templates, as numbers, for every
   half block of 32 words. Nothing after it reads a text.
2. The template words are ordered by the number of half blocks that hold them, over all rows, rare ones first; the counts
   are summed in map tasks, and one row for each template word comes to the driver.
3. Inverted join: a block that meets the threshold must hold one of the first |T| - need + 1 words of T in that order
   (prefix). Blocks are exploded to their prefix words, which meet the templates that have them there by an equal join; only
   blocks with enough template words come so far (length). A pair is kept at its first shared word alone, if enough words are left after it
   on both sides (position), and what passes is compared in full.
4. Matches join back by the row's number, which is unique, so no license, however many rows carry it, is a hot key. The
   templates are the caller's list, so the side that is broadcast has a row for each prefix word of a literal.

Defined cases: null is the empty text, with no words, labels or places and score 0; repeated rows and ids are each scanned
as they stand; an empty table gives no rows; any length of text is scanned whole; columns beside key and text are not read, whatever
their names. A template without words is refused, and so is a width given that need not hold every template whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import PLAIN_GAP, durable, lowered

THRESHOLD, WIDTH = 0.85, 64
#: Phrases that name a license, and openings of license notices.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def _places() -> Column:
    """(start, label) of the phrases in words_, in order."""

    def here(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<start:bigint,label:string>")
        for label, phrase in PHRASES:
            ends = w == phrase[-1]
            for back, word in enumerate(reversed(phrase[:-1]), 1):
                ends = ends & (F.get("words_", i - back) == word)
            found = F.when(ends, F.struct((i - (len(phrase) - 1)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    return F.array_compact(F.transform("words_", here))


def halves(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, width: int = WIDTH) -> DataFrame:
    """(row, key, n_words, places, halves): for each half block of a text the numbers of the template words in it, written once."""
    vocabulary, half = _vocabulary(templates), width // 2
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), lowered(F.coalesce(F.col(text), F.lit(""))).alias("low_"))
    rows = rows.select("row", "key", F.array_remove(F.split("low_", PLAIN_GAP), "").alias("words_"), F.contains("low_", F.lit("license")).alias("named_"))
    number = lambda w: F.array_position(_strings(vocabulary), w).cast("short")
    held = lambda i: F.array_distinct(F.transform(F.filter(F.slice("words_", i * half + 1, half), lambda w: w.isin(vocabulary)), number))
    last = F.greatest(F.ceil(F.size("words_") / half) - 1, F.lit(0)).cast("int")
    places = F.when(F.col("named_"), _places())
    return durable(rows.select("row", "key", F.size("words_").cast("long").alias("n_words"), places.alias("places"), F.transform(F.sequence(F.lit(0), last), held).alias("halves")), "halves")


def ordered_vocabulary(held: DataFrame, templates=TEMPLATES) -> list[str]:
    """The distinct words of the templates, those in the fewest half blocks first, ties by code point."""
    vocabulary = _vocabulary(templates)
    words = held.select(F.explode("halves").alias("half")).select(F.explode("half").alias("word"))
    counts = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(vocabulary.index(w) + 1, 0), w))


def matched(held: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, matches): the distinct (label, score) of the pairs of block and template that meet the threshold."""
    vocabulary, order = _vocabulary(templates), ordered_vocabulary(held, templates)
    rank = {w: i for i, w in enumerate(order)}
    posted, prefixes, least = [], set(), math.inf
    for label, notice in templates:
        tokens = sorted(rank[w] for w in set(notice.split()))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        listed = F.array(*[F.lit(t) for t in tokens]).alias("tokens")
        for i in range(len(tokens) - need + 1):
            posted.append(F.struct(F.lit(tokens[i]).alias("word"), F.lit(i).alias("nth"), F.lit(label).alias("label"), F.lit(need).alias("need"), listed))
        prefixes, least = prefixes | set(tokens[: len(tokens) - need + 1]), min(least, need)
    index = held.sparkSession.range(1).select(F.inline(F.array(*posted)))
    ranks = F.array(*[F.lit(rank[w]) for w in vocabulary])
    # A half meets its neighbour inside the row, and only what the two hold together is exploded; the last half is the second one of its block, unless it is the only one.
    half = lambda at: F.coalesce(F.get("halves", at), F.array().cast("array<smallint>"))
    together = lambda at: F.sort_array(F.transform(F.array_union(half(at), half(at + 1)), lambda n: F.get(ranks, n - 1)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("halves") - 2, F.lit(0)))
    blocks = held.select("row", F.explode(F.transform(starts, together)).alias("block")).where(F.size("block") >= least)
    probes = blocks.select("row", "block", F.explode(F.array_intersect("block", F.array(*[F.lit(p) for p in sorted(prefixes)]))).alias("word"))
    pairs = probes.join(F.broadcast(index), "word").where(F.size("block") >= F.col("need"))
    first = ~F.arrays_overlap(F.slice("tokens", 1, F.col("nth")), "block")
    left = F.least(F.size("tokens") - F.col("nth"), F.size("block") - F.array_position("block", F.col("word")) + 1)
    pairs = pairs.where(first & (left >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "block"))
    found = pairs.withColumn("shared", shared).where("shared >= need").select("row", F.struct("label", (F.col("shared") / F.size("tokens")).alias("score")).alias("match"))
    return found.groupBy("row").agg(F.sort_array(F.collect_set("match")).alias("matches"))


def width_of(templates=TEMPLATES) -> int:
    """The words of a block: WIDTH, or as many as it takes for some block to hold the longest template whole, wherever that stands."""
    return max(WIDTH, 2 * (max(len(notice.split()) for _, notice in templates) - 1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", *, templates=TEMPLATES, threshold: float = THRESHOLD, width: int | None = None) -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, score) of the join.

    The score is the largest containment that meets the threshold, 1 where a phrase stands, else 0.
    """
    width = width or width_of(templates)
    for label, notice in templates:
        if not 0 < len(notice.split()) <= width // 2 + 1:
            raise ValueError(f"a template of {label} has {len(notice.split())} words; blocks of {width} words hold up to {width // 2 + 1} whole")
    held = halves(docs, key, text, templates, width)
    matches = durable(matched(held, templates, threshold), "matches")
    rows = held.select("row", "key", "n_words", F.coalesce("places", F.array().cast("array<struct<start:bigint,label:string>>")).alias("places")).join(matches, "row", "left")
    none = F.array().cast("array<struct<label:string,score:double>>")
    rows = rows.withColumns({"n_base": F.size("places").cast("long"), "own": F.col("places.label"), "matches": F.coalesce("matches", none)})
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        F.col("key").alias(key), "n_words", "n_base", F.get("places", F.lit(0))["start"].alias("first_word"), F.get("places", F.size("places") - 1)["start"].alias("last_word"),
        joined(F.col("own")).alias("base_labels"), joined(F.concat("own", F.col("matches.label"))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.score"), F.lit(0.0))).alias("score"), "matches",
    )
