"""License notices in texts: exact set-similarity join of text blocks with templates, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices that licenses ask to be given, with the labels of this method.
TEMPLATES = (
    ("spdx:agpl-3.0", "under the terms of the GNU Affero General Public License"),
    ("spdx:apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("spdx:apache-2.0", "you may not use this file except in compliance with the License"),
    ("spdx:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("spdx:bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("spdx:cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("spdx:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("spdx:cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("spdx:gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("spdx:gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("spdx:isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("spdx:lgpl", "under the terms of the GNU Lesser General Public License"),
    ("spdx:mit", "Released under the MIT License"),
    ("spdx:mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("spdx:mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("spdx:unlicense", "This is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in texts whose letters A-Z are not yet lowered, and what stands between them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LINE_END = r"[\n\r]+"


def words_of(text: str) -> list[str]:
    """The words of a template."""
    lowered = "".join(c.lower() if c in _UPPER else c for c in text)
    return "".join(c if c in _LOWER or c.isdigit() or ord(c) > 127 else " " for c in lowered).split()


@dataclass(frozen=True)
class Template:
    """The distinct words of a notice and the number of them that a block must hold."""

    label: str
    words: frozenset[str]
    needed: int
    #: Words of the notice with repeats, up to a multiple of four.
    length: int = 0


def templates(pairs: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    """Templates of (label, text) pairs; containment means needed / distinct words >= ``threshold``."""
    made = []
    for label, text in pairs:
        listed = words_of(text)
        words = frozenset(listed)
        if words:
            made.append(Template(label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), -(-len(listed) // 4) * 4))
    return made


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrase_columns(text: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels of a text column that is not null.

    Only texts that hold a phrase's last word are spaced out; phrases must not overlap each other.
    """
    last_words = "|".join(sorted({p.split()[-1] for p, _ in phrases}))
    hint = text.rlike(f"(?i)(?:{last_words})")
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, _BETWEEN, " "), F.lit(" "))
    any_phrase = "(?:" + "|".join(p for p, _ in phrases) + ")"
    places = F.regexp_count(spaced, F.lit(f"(?i) {any_phrase}(?= )"))
    n_base = F.when(hint, places).otherwise(0)
    before = lambda many: F.regexp_extract(spaced, f"(?is)^(.*{many})(?= {any_phrase} )", 1)
    index = lambda many: F.regexp_count(before(many), F.lit("[^ ]+")).cast("long")
    found = hint & spaced.rlike(f"(?i) {any_phrase} ")
    labels = [F.when(spaced.rlike(f"(?i) {p} "), F.lit(label)) for p, label in phrases]
    return {
        "n_words": F.regexp_count(text, F.lit(_WORD)).cast("long"),
        "n_base": n_base.cast("long"),
        "first_word": F.when(found, index("?")),
        "last_word": F.when(found, index("")),
        "base_labels": F.when(hint, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")),
    }


def _line_blocks(vocabulary: Sequence[str], fewest: int) -> Column:
    """The known words of each line of ``body``, where there are enough."""
    lines = F.split(F.translate("body", _UPPER, _LOWER), _LINE_END)
    known = F.transform(lines, lambda line: F.array_intersect(F.split(line, _BETWEEN), _texts(vocabulary)))
    return F.filter(known, lambda words: F.size(words) >= fewest)


def _window_blocks(wanted: Sequence[Template]) -> tuple[Column, Column]:
    """(column ``every`` of all words, column of (length, known words)) of windows of twice a notice's length that start every length, where there are enough."""
    every = F.filter(F.split(F.translate("body", _UPPER, _LOWER), _BETWEEN), lambda word: word != "")

    def of_length(length: int) -> Column:
        own = [t for t in wanted if t.length == length]
        known, fewest = _texts(sorted(set().union(*(t.words for t in own)))), min(t.needed for t in own)
        starts = F.sequence(F.lit(1), F.greatest(F.size("every") - length, F.lit(1)), F.lit(length))
        words = F.transform(starts, lambda at: F.array_intersect(F.slice("every", at, 2 * length), known))
        enough = F.filter(words, lambda block: F.size(block) >= fewest)
        return F.transform(enough, lambda block: F.struct(F.lit(length).alias("length"), block.alias("words")))

    lengths = sorted({t.length for t in wanted})
    empty = F.array().cast("array<struct<length:int,words:array<string>>>")
    return every, F.flatten(F.array(*map(of_length, lengths))) if lengths else empty


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.85,
    windows: bool = False,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    A block is a line of a text, as in the SQL of the registered query; a notice wrapped over lines is then not
    found, and a text without line breaks is one block. With ``windows`` line breaks count for nothing: blocks of
    a notice are windows of twice its length (up to a multiple of four words) that overlap by half, so any stretch
    of its length lies in one. A block matches a notice if it holds at least ``threshold`` of the notice's
    distinct words. The join is exact: words outside all notices cannot add to an overlap and go first; blocks
    with too few words left go by length; the words of blocks and notices stand in one order, rare in the
    corpus before common; a pair can reach the overlap only if it shares a word among the first
    size - needed + 1 of both (prefix filter), and the words after the shared one suffice (position filter).
    The pairs that are left are counted in full. ``score`` is the largest containment of a match, else 0.

    ``base_labels`` and ``labels`` are sorted and comma-joined; a text without any has empty strings. Null
    texts count as empty; equal rows and null ids each keep their row; other columns are not read. The list of
    notices is a parameter of a few KB: only their words' counts reach the driver and only they are broadcast.
    """
    spark = docs.sparkSession
    wanted = templates(notices, threshold)
    vocabulary = sorted(set().union(*(t.words for t in wanted))) if wanted else [""]
    fewest = min((t.needed for t in wanted), default=1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("body"))
    if windows:
        every, cut = _window_blocks(wanted)
        own = own.withColumn("every", every)
    else:
        cut = _line_blocks(vocabulary, fewest)
    marked = cut_lineage(
        own.select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            *[c.alias(n) for n, c in phrase_columns(F.col("body"), phrases).items()],
            cut.alias("blocks"),
        )
    )
    if windows:
        blocks = marked.select("row", F.posexplode("blocks").alias("block", "cut")).select("row", "block", "cut.words", "cut.length")
    else:
        blocks = marked.select("row", F.posexplode("blocks").alias("block", "words"))
    length = ["length"] if windows else []
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    index: list[tuple] = []
    for number, t in enumerate(wanted):
        ordered = [w for w in order if w in t.words]
        prefix = ordered[: len(ordered) - t.needed + 1]
        tail = (ordered, t.length) if windows else (ordered,)
        index += [(w, number, t.label, i, len(ordered), t.needed, *tail) for i, w in enumerate(prefix)]
    shape = "word string, notice int, label string, place int, members int, needed int, members_in_order array<string>" + (", length int" if windows else "")
    prefixes = F.broadcast(spark.createDataFrame(index, shape))

    ranked = blocks.select("row", "block", *length, F.array_intersect(_texts(order), F.col("words")).alias("words"))
    size = F.size("words")
    probe = ranked.select("*", F.posexplode(F.slice("words", 1, size - (fewest - 1))).alias("at", "word"))
    rest = 1 + F.least(F.col("members") - F.col("place"), size - F.col("at")) - 1
    candidates = probe.join(prefixes, ["word", *length]).where(
        (size >= F.col("needed")) & (F.col("at") <= size - F.col("needed")) & (rest >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("words", "members_in_order"))
    matches = candidates.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("needed"))
    hits = matches.groupBy("row").agg(
        F.collect_set("label").alias("own_labels"), F.max(F.col("overlap") / F.col("members")).alias("score")
    )
    none = F.array().cast("array<string>")
    joined = marked.join(hits, "row", "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words", "n_base", "first_word", "last_word",
        listed(F.col("base_labels")).alias("base_labels"),
        listed(F.concat("base_labels", F.coalesce("own_labels", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
