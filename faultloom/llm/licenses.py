"""License notices: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of public license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
#: A window that contains 0.8 of a template's shingles has similarity 0.6 or more to it (see windows below), and
#: so shares a band with probability 1 - (1 - 0.6 ** 2) ** 16 = 0.9992 or more; an exact copy of a template that
#: is as long as the window always does.
BANDS, ROWS = 16, 2
CONTAINMENT = 0.8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingles(words: Column) -> Column:
    """Distinct hashes of five words; a shorter sequence is one shingle."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))
    return F.when(n > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def _bands(size: Column, shingles: Column) -> Column:
    """The hashes of all bands of the MinHash values of a set; `size` keeps windows of one length apart."""
    least = [_least(shingles, i) for i in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(size, F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _least(shingles: Column, seed: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))


def required_words(templates: Mapping[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Words of which a text must hold one to contain the given share of any template's shingles.

    For every template, longest words first, until so many shingles hold one of them that the others are fewer
    than the share asked for.
    """
    needed: set[str] = set()
    for text in templates.values():
        words = re.findall(r"[^\W_]+", text.lower())
        grams = {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))}
        mine: set[str] = set()
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(1 for g in grams if not mine & set(g)) < containment * len(grams):
                break
            mine.add(word)
        needed |= mine
    return sorted(needed)


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, windows): the notices each document contains.

    A notice is contained if one window of the text holds at least `containment` of the notice's distinct
    shingles of five words (in lower case, words are runs of letters and digits). For a template of n words,
    windows have n + s - 1 words and start at every s-th word, s = max(1, n / 8), so every stretch of n words
    lies whole in one. containment is the best window's share, first_word its place, windows how many match.

    Windows without any of the words that every match must hold (see required_words) are left out before
    anything is hashed, which loses none. Templates are a parameter of fixed size; they are the only
    table that is broadcast. NULL and empty texts contain nothing; documents without a match have no row. Rows
    that repeat an identifier are judged one by one, and the best of them counts. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    needed = required_words(templates, containment)
    table = spark.createDataFrame([(k, v) for k, v in templates.items()] or [("", "")], "license string, notice string").where("license <> ''")
    table = table.withColumn("words", _words(F.col("notice"))).withColumn("n", F.size("words")).where("n > 0")
    table = table.select("license", "n", _shingles(F.col("words")).alias("notice_shingles"))
    counted = [len(re.findall(r"[^\W_]+", t.lower())) for t in templates.values()]
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(max(1, n // 8)).alias("step")) for n in sorted(set(counted)) if n])

    hit = "(?iu)" + "|".join(re.escape(w) for w in needed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(hit))
    rows = rows.select("doc_id", _words(F.col("t")).alias("words"))
    marked = F.filter(F.transform("words", lambda w, i: F.when(w.isin(needed), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("marks", marked).where(F.size("marks") > 0)
    kind = rows.withColumn("kind", F.explode(kinds)).select("doc_id", "words", "marks", "kind.n", "kind.step")
    # The windows that hold a marked word at m start at multiples of step from m - (n + step - 2) to m.
    first = lambda m: F.greatest(F.ceil((m - F.col("n") - F.col("step") + 2) / F.col("step")), F.lit(0)).cast("int")
    starts = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(first(m), F.floor(m / F.col("step")).cast("int")))))
    window = kind.withColumn("start", F.explode(starts)).withColumn("start", F.col("start") * F.col("step"))
    window = window.select("doc_id", "n", "start", _shingles(F.slice("words", F.col("start") + 1, F.col("n") + F.col("step") - 1)).alias("shingles"))
    banded = window.withColumn("band", F.explode(_bands(F.col("n"), F.col("shingles"))))
    of_notice = table.withColumn("band", F.explode(_bands(F.col("n"), F.col("notice_shingles")))).drop("n")
    found = banded.join(F.broadcast(of_notice), "band")
    share = F.size(F.array_intersect("shingles", "notice_shingles")) / F.size("notice_shingles")
    found = found.select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= containment)
    one = found.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))
    return one.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.max_by("start", F.struct("share", -F.col("start"))).cast("long").alias("first_word"),
        F.count("*").alias("windows"))
