"""License scans by a positional rare-token index; DataFrame expressions only.

Templates are short licence wordings with mandatory key phrases.  Every template is indexed under
its rarest words (highest IDF over the scanned files) with their positions in it.  A file's
occurrences of those words are joined with the postings; occurrences of one template that agree
on where it would start are intersected; a start that enough of the index words agree on is
verified word by word: all mandatory phrases must stand at their relative positions and the
rest adds to the score by IDF.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import placed_words, word_array


@dataclass(frozen=True)
class Template:
    """``base``: every place of it counts.  Without key phrases the whole text is mandatory."""

    name: str
    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False


# The base phrases and their labels.
BASE = (
    Template("base-cc", "cc-by", "cc by", base=True),
    Template("base-gpl", "gpl", "general public license", base=True),
    Template("base-reserved", "reserved", "all rights reserved", base=True),
)

# Common licence notices, with the phrases that must not be missing.
NOTICES = (
    Template("apache-line", "apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-notice", "apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("mit-line", "mit", "released under the mit license", ("the mit license",)),
    Template("mit-line-2", "mit", "licensed under the mit license", ("the mit license",)),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("gpl-line", "gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-line-2", "gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-grant", "gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    Template("lgpl", "lgpl", "gnu lesser general public license", ()),
    Template("agpl", "agpl", "gnu affero general public license", ()),
    Template("mpl", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-name", "cc", "licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("reserved-notice", "proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying", "strictly prohibited")),
)


def _places(template: Template) -> list[tuple[int, int]]:
    """(offset, length) of the mandatory phrases among the template's words."""
    words, out = template.text.split(), []
    for phrase in template.phrases or (template.text,):
        p = phrase.split()
        at = next(i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
        out.append((at, len(p)))
    return out


def _index(spark: SparkSession, templates: tuple[Template, ...], idf: dict[str, float], rare: int) -> DataFrame:
    """One row for each template and index word: where it stands, and what to verify."""
    rows = []
    for t in templates:
        words = t.text.split()
        mandatory = sorted({i for a, n in _places(t) for i in range(a, a + n)})
        # the index words are mandatory ones, so a verified place is never missed
        ranked = sorted({words[i]: i for i in mandatory}.items(), key=lambda x: (-idf[x[0]], x[1]))
        # common words would not narrow anything down; the phrases are verified in full anyway
        chosen = [x for x in ranked if idf[x[0]] >= idf[ranked[0][0]] / 2][: 1 if t.base else rare]
        weights = [idf[w] for w in words]
        for word, i in chosen:
            rows.append((word, i, t.name, t.label, t.base, words, mandatory, mandatory[0], mandatory[-1], weights, sum(weights), len(chosen)))
    return spark.createDataFrame(
        rows, "word string, offset int, template string, label string, base boolean, twords array<string>, mandatory array<int>, from int, to int, weights array<double>, weight double, asked int"
    )


def scan_licenses(
    rows: DataFrame,
    templates: tuple[Template, ...] = BASE + NOTICES,
    rare: int = 3,
    least_share: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence wordings in every whole text.

    Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.  A template
    is found at a place when all of its index words (up to ``rare`` of its rarest mandatory words, none with
    less than half the IDF of the rarest) agree
    on it, all mandatory phrases stand there, and words worth ``least_share`` of its IDF match.  Index
    words come from the mandatory phrases, so requiring all of them loses nothing.  Words of a
    template before its mandatory phrases may lie before the text's start and count as missing.

    Returns one row for each row: id, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (smallest and largest start of them, else null),
    ``base_labels`` and ``labels`` (distinct, sorted, comma-joined, empty if none), ``score``
    (largest share of a found template, 0 without).  Null and empty texts have no words.  Repeated
    rows and null ids stay; an empty table gives an empty result; other columns are ignored.
    The index has a row for each template and rare word, a number fixed by the templates, and is
    broadcast; the driver gets one count for each word of the templates.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "licenses")
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    text = F.col(text_col)
    present = rows.select(F.explode(F.array_intersect(word_array(text), F.array(*map(F.lit, vocabulary)))).alias("word"))
    files = rows.count()
    counts = {r["word"]: log((files + 1) / (r["df"] + 0.5)) for r in present.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    most = max([1.0, *counts.values()]) + 1
    idf = {w: max(0.01, counts.get(w, most)) for w in vocabulary}

    index = F.broadcast(_index(spark, templates, idf, rare))
    found = placed_words(rows, id_col, text_col).join(index, "word", "left")
    here, start = F.col("pos") == F.col("n"), F.col("pos") - F.col("offset")
    # no lambda expressions here: they would end the generated code and copy the words for each row
    hit = F.col("template").isNotNull() & (start + F.col("from") >= 0) & (start + F.col("to") < F.col("n"))
    context = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("twords") + F.least(start, F.lit(0)))
    found = found.where(here | hit).select(
        "id", "key", "n", here.alias("itself"), "template", "label", "base", "twords", "mandatory", "weights", "weight", "asked", F.when(hit, start).alias("start"), F.when(hit, context).alias("context")
    )
    found = scratch.keep(found)
    shift = F.greatest(-F.col("start"), F.lit(0))  # words of the template before the text
    same = F.transform("twords", lambda w, i: F.coalesce((i >= shift) & (F.get("context", i - shift) == w), F.lit(False)))
    met = (
        found.where("start is not null")
        .groupBy("id", "key", "template", "start")
        .agg(F.count(F.lit(1)).alias("votes"), *(F.first(c).alias(c) for c in ("label", "base", "twords", "mandatory", "weights", "weight", "asked", "context", "n")))
        .withColumn("same", same)
        .where((F.col("votes") >= F.col("asked")) & F.forall("mandatory", lambda i: F.get("same", i)))
        .withColumn("share", F.aggregate(F.arrays_zip("same", "weights"), F.lit(0.0), lambda a, z: a + F.when(z["same"], z["weights"]).otherwise(0.0)) / F.col("weight"))
        .where(F.col("share") >= least_share)
    )
    base_start = F.when(F.col("base"), F.col("start"))
    per_text = met.groupBy("id", "key").agg(
        F.count(base_start).alias("n_base"),
        F.min(base_start).cast("long").alias("first_word"),
        F.max(base_start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    texts = found.where("itself").select("id", "key", "n")
    return texts.join(per_text, (texts["id"].eqNullSafe(per_text["id"])) & (texts["key"] == per_text["key"]), "left").select(
        texts["id"].alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
