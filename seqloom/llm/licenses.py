"""License scans: MinHash bands over overlapping windows of text, verified by exact containment.

DataFrame functions only.  Words are runs of a-z and 0-9 after A-Z are lower-cased; shingles are five
words.  Templates of similar length share a window length and a stride such that every occurrence lies
whole in some window.  Each of BANDS bands holds one minimum (a row a band), so a window that holds a
template, with a Jaccard likeness of a quarter at the least, meets it in some band with a chance of
1 - 0.75 ** 32 > 0.9998.  The minimum under band k is the shingle hash nearest to seed k by xor.

A window can agree with a template in band k only if it holds the very shingle that is the template's
minimum there.  Texts and windows without any such shingle are therefore passed over first; that loses
no agreement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_text

WORDS, BANDS = 5, 32
CONTAINED = 0.8

#: Public licence notices, by the name of the licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles of a window beyond those of the class's longest template: stride - 1, half of that length.
CLASSES = (2, 4, 8, 16, 32, 64)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """Hash of each run of five words, in order; no hash for a shorter text."""

    def hashes(words: Column) -> Column:
        own = [F.get(words, F.lit(0))]  # keeps the list bound though a text be short
        last = F.size(words) - WORDS
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
        return F.when(last >= 0, each).otherwise(F.slice(F.array(F.xxhash64(*own)), 1, 0))

    return bind(word_list(text), hashes)


def _stride(longest: int) -> int:
    return max(1, longest // 2)


def _window(longest: int) -> int:
    return longest + _stride(longest) - 1


def _bands(hashes: Column, seeds: Column) -> Column:
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def _longs(values) -> Column:
    """An array of fixed numbers."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """Which templates each whole text contains.

    One row for each doc_id and licence with some window that holds at least `contained` of the
    template's distinct shingles: doc_id, license, n_shingles (of the template), matched (the most in
    one window), n_windows, first_word (start of the first such window).  Null, empty and short texts
    match nothing; rows that repeat a doc_id are scanned each; an empty table gives no rows; extra
    columns are ignored.  Templates need five words at least.
    """
    spark = docs.sparkSession
    listed = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    seeds = [int(x) for x in spark.range(BANDS).select(F.xxhash64(F.lit(977), "id").alias("s")).toPandas()["s"]]
    known = listed.select("license", F.array_distinct(shingle_hashes(F.col("text"))).alias("own")).filter(F.size("own") > 0)
    # a handful of rows, as many as there are templates
    known = sorted((r.license, list(r.own), list(r.bands)) for r in known.withColumn("bands", _bands(F.col("own"), _longs(seeds))).collect())
    groups: dict[int, list] = {}
    for name, own, bands in known:
        groups.setdefault(next((c for c in CLASSES if len(own) <= c), len(own)), []).append((name, own, bands))
    telling = {c: sorted({b ^ s for _, _, bands in found for b, s in zip(bands, seeds)}) for c, found in groups.items()}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(as_text()).alias("hashes"))
    if not groups:
        return spark.createDataFrame([], "doc_id long, license string, n_shingles long, matched long, n_windows long, first_word long")
    # stored, so that the texts are read and hashed once for all classes
    some = Stored(base.filter(F.arrays_overlap("hashes", _longs(sorted({x for t in telling.values() for x in t})))), "license-hashes").read()
    each = []
    for longest, found in sorted(groups.items()):
        stride, width = _stride(longest), _window(longest)
        keys = _longs(telling[longest])
        windows = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)), F.lit(stride))))
        windows = windows.select("doc_id", "at", F.slice("hashes", F.col("at") + 1, width).alias("part")).filter(F.arrays_overlap("part", keys))
        signed = windows.select("doc_id", "at", "part", F.posexplode(_bands(F.col("part"), _longs(seeds))).alias("band", "least"))
        rows = [(name, k, b) for name, _, bands in found for k, b in enumerate(bands)]
        bands = spark.createDataFrame(rows, "license string, band int, least long")
        owns = spark.createDataFrame([(name, own) for name, own, _ in found], "license string, own array<long>")
        # templates and their bands: a few hundred rows
        met = signed.join(F.broadcast(bands), ["band", "least"]).groupBy("doc_id", "at", "license").agg(F.first("part").alias("part"))
        each.append(
            met.join(F.broadcast(owns), "license")
            .select("doc_id", "license", "at", F.size("own").cast("long").alias("n_shingles"), F.size(F.array_intersect("part", "own")).cast("long").alias("matched"))
            .filter(F.col("matched") >= contained * F.col("n_shingles"))
        )
    return (
        reduce(DataFrame.unionByName, each)
        .groupBy("doc_id", "license", "n_shingles")
        .agg(F.max("matched").alias("matched"), F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word"))
    )


def scan_sql(templates: dict[str, str] | None = None, contained: float = CONTAINED) -> str:
    """The same by exact containment in every window, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((templates or TEMPLATES).items()))
    longest = "CASE " + " ".join(f"WHEN len(own) <= {c} THEN {c}" for c in CLASSES) + " ELSE len(own) END"
    return f"""
    WITH t AS (SELECT license, list_distinct({grams}) AS own FROM (SELECT license, {words} AS words FROM (VALUES {rows}) v(license, text))),
    sized AS (SELECT license, own, {longest} AS longest FROM t WHERE len(own) > 0),
    shaped AS (SELECT *, greatest(1, longest // 2) AS stride FROM sized),
    d AS (SELECT doc_id, {grams} AS hashes FROM (SELECT doc_id, {words} AS words FROM documents)),
    p AS (SELECT doc_id, unnest(hashes) AS gram, unnest(range(len(hashes))) AS pos FROM d),
    hit AS (
        SELECT p.doc_id, s.license, len(s.own) AS n, s.longest, s.stride, p.gram, p.pos
        FROM p JOIN (SELECT *, unnest(own) AS gram FROM shaped) s USING (gram)
    ),
    w AS (
        SELECT doc_id, license, n, gram, pos, longest + stride - 1 AS width,
            unnest(range(greatest(0, (pos - (longest + stride - 1)) // stride), pos // stride + 1)) * stride AS start
        FROM hit
    ),
    c AS (
        SELECT doc_id, license, n, start, count(DISTINCT gram) AS matched FROM w
        WHERE start <= pos AND pos < start + width GROUP BY ALL
    )
    SELECT doc_id, license, n::BIGINT AS n_shingles, max(matched)::BIGINT AS matched, count(*)::BIGINT AS n_windows, min(start)::BIGINT AS first_word
    FROM c WHERE matched >= {contained} * n GROUP BY doc_id, license, n
    """
