"""License scan: MinHash bands over overlapping text windows. Native DataFrame operations only.

A text's words are runs of ASCII letters and digits in lower case; a shingle is
five of them. Only stretches whose neighbouring words all follow each other in some
template can hold a template's shingle, so a text is first reduced to its stretches
of five words or more; nothing that could match is left out. Overlapping windows
of as many shingles as the templates' windows have get MinHash signatures, cut
into bands. A template is retrieved where a band agrees, and matches where the
text holds at least 0.8 of its distinct shingles.

What the bands must answer for follows from the containment. A template of P
shingles that are kept to 0.8 has lost 0.2 P at most, and a break between two of its
words costs four. So what is kept lies in 1 + P / 20 runs at most, and
the longest has 16 P / (P + 20) shingles or more, or, with P below 20, 0.8 P.
Windows have 16 shingles or, for a shorter template, the power of two up to P: the
longest run has at least half a window. Text windows follow each other at
half their length, so one holds half a window of the run, and shares it with the
template's window there: a Jaccard similarity of n/2 in 2n - n/2, a third.

With r rows a band and b bands a window of Jaccard similarity s to a template's
window is retrieved with probability 1 - (1 - s**r)**b; bands() makes sure that
it is at least 0.999 at a third.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.license_texts import TEXTS
from quillon.llm.shared import bounded, stored

SHINGLE = 5
CONTAINMENT = 0.8
WINDOW = 16
BANDS, BAND_ROWS = 24, 1
#: The Jaccard similarity that bands() must answer for.
WORST = 1 / 3
#: Bytes of stretches that a task cuts to windows.
TASK_BYTES = 1 << 20

# Notices by which texts name their license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-short": "Released under the MIT License.",
    "MIT-short-2": "Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved. No part of this may be reproduced without permission.",
}
TEMPLATES = NOTICES | TEXTS


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^0-9a-z]+"), lambda w: w != "")


def shingles(of: Column) -> Column:
    """Five words each, in order; fewer words are one shingle."""
    n = F.size(of)
    return F.when(n < SHINGLE, F.filter(F.array(F.array_join(of, " ")), lambda s: s != "")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(of, i, SHINGLE), " "))
    )


def bands(similarity: float = WORST, rows: int = BAND_ROWS, number: int = BANDS) -> float:
    """The chance that a window of this similarity is retrieved; ValueError below 0.999."""
    chance = 1 - (1 - similarity**rows) ** number
    if chance < 0.999:
        raise ValueError(f"{number} bands of {rows} retrieve a window of similarity {similarity} with a chance of {chance:.4f} only")
    return chance


def _salted(k: int) -> Callable[[Column], Column]:
    return lambda h: F.xxhash64(h, F.lit(k))


def band_hashes(window: Column) -> Column:
    """The window's bands, each with its number hashed in."""
    mins = [F.array_min(F.transform(window, _salted(k))) for k in range(BANDS * BAND_ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *mins[b * BAND_ROWS : (b + 1) * BAND_ROWS]) for b in range(BANDS)])


def windows(hashes: Column, length: Column | int, step: Column | int) -> Column:
    """Windows of `length` shingle hashes at every `step`; the last ends with the text, a short text is one."""
    length, step = (F.lit(x) if isinstance(x, int) else x for x in (length, step))
    last = F.greatest(F.size(hashes) - length, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last)))
    return F.transform(starts, lambda s: F.slice(hashes, s + 1, length))


def templates_table(spark: SparkSession, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(license, parts, length, pairs): the distinct shingles of each template, the length of its windows, hashes of its words that follow each other."""
    df = spark.createDataFrame(sorted(templates.items()), "license string, notice string").select("license", words("notice").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1)))
    df = df.select("license", F.array_distinct(shingles(F.col("w"))).alias("parts"), F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<long>")).alias("pairs"))
    power = F.pow(F.lit(2), F.floor(F.log2(F.size("parts")))).cast("int")
    return df.select("license", "parts", F.least(power, F.lit(WINDOW)).alias("length"), "pairs")


def stretches(of: Column, pairs: list[int]) -> Column:
    """The runs of five words or more of which each follows the one before in some template, their words joined by blanks."""
    before = F.concat(F.array(F.lit("")), of)
    marked = F.zip_with(of, before, lambda w, p: F.when(F.xxhash64(p, w).isin(pairs), w).otherwise(F.concat(F.lit("|"), w)))
    runs = F.transform(F.filter(F.split(F.array_join(marked, " "), r"\|"), lambda s: F.length(s) >= 2 * SHINGLE - 1), lambda s: F.trim(s))
    return F.filter(runs, lambda s: F.length(s) - F.length(F.translate(s, " ", "")) >= SHINGLE - 1)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, without their text, with `licenses`: an array of (license, containment), by license.

    It is empty without a match. Null and empty texts match nothing; rows that
    repeat are matched each. The templates are a parameter of the program, with
    their pairs of words in the plan. Other columns of docs pass unchanged; a clashing
    one is replaced.
    """
    bands()
    spark = docs.sparkSession
    known = stored(templates_table(spark, templates), "templates")
    pairs = [r.p for r in known.select(F.explode("pairs").alias("p")).distinct().orderBy("p").collect()]
    lengths = sorted({r.length for r in known.select("length").distinct().collect()})

    others = [c for c in docs.columns if c not in ("text", "licenses")]
    # explode: the words are made once, though they are looked at twice
    rows = docs.select(F.struct(*others or [F.lit(0).alias("_")]).alias("_row"), F.explode(F.array(words("text"))).alias("_words"))
    rows = rows.select("_row", F.coalesce(stretches(F.col("_words"), pairs), F.array().cast("array<string>")).alias("stretches"))
    table = stored(rows.withColumn("_key", F.monotonically_increasing_id()), "stretches")

    found = table.where(F.size("stretches") > 0).select("_key", F.posexplode("stretches").alias("_at", "stretch"))
    size = found.agg(F.coalesce(F.sum(F.length("stretch")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    found = found.repartition(tasks, "_key", "_at").select("_key", shingles(F.split("stretch", " ")).alias("parts"))
    hashed = found.select("_key", F.transform("parts", lambda s: F.xxhash64(s)).alias("hashes"))
    hashed = stored(hashed, "hashes")
    cut = hashed.select("_key", F.explode(F.flatten(F.array(*[windows(F.col("hashes"), n, max(1, n // 2)) for n in lengths]))).alias("window"))
    asked = cut.select("_key", F.explode(band_hashes(F.col("window"))).alias("band")).distinct()
    offered = known.select("license", F.explode(windows(F.transform("parts", lambda s: F.xxhash64(s)), F.col("length"), F.lit(1))).alias("window"))
    offered = bounded(stored(offered.select("license", F.explode(band_hashes(F.col("window"))).alias("band")).distinct(), "offered"))
    candidates = stored(asked.join(offered, "band").select("_key", "license").distinct(), "candidates")

    own = found.join(candidates.select("_key").distinct(), "_key", "left_semi").select("_key", F.explode("parts").alias("part")).distinct()
    parts = bounded(stored(known.select("license", F.size("parts").alias("n"), F.explode("parts").alias("part")), "parts"))
    shared = own.join(parts, "part").groupBy("_key", "license").agg((F.count("*") / F.first("n")).alias("containment")).where(F.col("containment") >= containment)
    checked = shared.join(candidates, ["_key", "license"], "left_semi")
    matched = checked.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("license", "containment"))).alias("licenses"))
    empty = F.array().cast("array<struct<license:string,containment:double>>")
    out = table.join(matched, "_key", "left")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in others], F.coalesce("licenses", empty).alias("licenses"))
