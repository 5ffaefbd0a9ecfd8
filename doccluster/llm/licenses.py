"""License scans: MinHash bands over text windows, then exact containment.

Templates and texts are taken as words of ASCII letters and digits in lower
case, and as shingles of five words. Windows of a text have ``W`` shingles and
start every ``W / 4``; a template of at most ``3 W / 4`` shingles lies whole in
one of them. A template is compared with the smallest such windows, so at least
3/8 of the shingles of one window are its own, and with BANDS bands of one
minimum each a window that holds it collides with it with a probability of at
least ``1 - (5/8)**16``, 99.9 %; one that holds four fifths of it with 99 %.

A band can only collide in a window that holds the template's smallest shingle
of that band. So windows are formed around those shingles only; all others
would collide with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

# --- fixed values: notices in common use -------------------------------------
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
        " except in compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:"
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation"
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' software and associated documentation files (the "Software"), to deal in the Software'
        " without restriction"
    ),
}
# ------------------------------------------------------------------------------
WORDS = 5
BANDS = 16
CONTAINMENT = 0.8


@dataclass(frozen=True)
class Scale:
    """Windows of ``size`` shingles, ``step`` apart."""

    size: int

    @property
    def step(self) -> int:
        return max(1, self.size // 4)


def scale_for(shingles: int) -> Scale:
    """The smallest windows that hold a template of so many shingles whole."""
    size = 1 if shingles == 1 else 4
    while size > 1 and shingles > size * 3 // 4:
        size *= 2
    return Scale(size)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(listed: Column) -> Column:
    """The shingles of an array of at least five words."""
    starts = F.sequence(F.lit(1), F.size(listed) - (WORDS - 1))
    return F.transform(starts, lambda n: F.array_join(F.slice(listed, n, WORDS), " "))


def shingle_hashes(listed: Column) -> Column:
    """A hash per shingle of the array ``listed``, null for fewer than five words."""
    starts = F.sequence(F.lit(0), F.size(listed) - WORDS)
    return F.when(
        F.size(listed) >= WORDS,
        F.transform(starts, lambda n: F.xxhash64(*[listed[n + i] for i in range(WORDS)])),
    )


def minimum(hashes: Column, band: int) -> Column:
    """The smallest hash of a band's own order of the shingles."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(license, size, shingles, band, smallest, hash)``, one row per template and band.

    ``smallest`` is the band's value and ``hash`` the shingle it comes from.
    Templates of fewer than five words are refused.
    """
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    listed = rows.select("license", words(F.col("text")).alias("w")).select(
        "license",
        shingle_hashes(F.col("w")).alias("h"),
        F.when(F.size("w") >= WORDS, F.array_distinct(_shingles(F.col("w")))).alias("shingles"),
    )
    order = F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.array_min(
                    F.transform("h", lambda h: F.struct(F.xxhash64(h, F.lit(b)).alias("smallest"), h.alias("hash")))
                ).alias("least"),
            )
            for b in range(BANDS)
        ]
    )
    return listed.select("license", "shingles", F.size("h").alias("n"), F.explode(order).alias("o")).select(
        "license", "shingles", "n", "o.band", "o.least.smallest", "o.least.hash"
    )


def _starts(hashes: Column, keys: list[int], scale: Scale) -> Column:
    """Windows ``(size, start)`` of a scale that hold one of the shingles ``keys``."""
    wanted = F.array(*[F.lit(k).cast("bigint") for k in keys])
    places = F.filter(
        F.sequence(F.lit(0), F.size(hashes) - 1), lambda n: F.array_contains(wanted, hashes[n])
    )

    def around(place: Column) -> Column:
        first = F.greatest(F.floor((place - scale.size) / scale.step) + 1, F.lit(0))
        return F.sequence(first.cast("int"), F.floor(place / scale.step).cast("int"))

    return F.transform(
        F.array_distinct(F.flatten(F.transform(places, around))),
        lambda n: F.struct(F.lit(scale.size).alias("size"), (n * scale.step).alias("start")),
    )


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, licenses)`` for every row of ``docs``.

    ``licenses`` is a sorted array of ``(license, containment)``: the templates
    of which a window holds at least CONTAINMENT of the shingles, with the
    largest such share. It is empty for null texts and texts of fewer than five
    words. Repeated rows and null ids stay rows of their own.
    """
    spark = docs.sparkSession
    # BANDS rows per template, a parameter of this function
    bands = template_bands(spark, templates).collect()
    if any(r.shingles is None for r in bands):
        raise ValueError(f"templates need {WORDS} words or more")
    scales = {r.license: scale_for(r.n) for r in bands}
    keys = F.array(*[F.lit(k).cast("bigint") for k in sorted({r.hash for r in bands})])
    listed = docs.select(
        F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words")
    ).withColumn("hashes", shingle_hashes(F.col("words")))
    hit = F.arrays_overlap("hashes", keys)
    base = materialize(
        listed.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.when(hit, F.col("words")).alias("words"),
            F.when(hit, F.col("hashes")).alias("hashes"),
        ),
        "base",
    )
    windows = F.concat(
        *[
            _starts(
                F.col("hashes"), sorted({r.hash for r in bands if scales[r.license] == scale}), scale
            )
            for scale in sorted(set(scales.values()), key=lambda s: s.size)
        ]
    )
    found = base.filter("hashes IS NOT NULL").select(
        "uid", "words", "hashes", F.explode(windows).alias("w")
    )
    piece = F.slice("hashes", F.col("w.start") + 1, F.col("w.size"))
    found = found.select(
        "uid",
        "w.size",
        F.slice("words", F.col("w.start") + 1, F.col("w.size") + (WORDS - 1)).alias("words"),
        piece.alias("hashes"),
    )
    signed = found.select(
        "uid",
        "size",
        "words",
        F.posexplode(F.array(*[minimum(F.col("hashes"), b) for b in range(BANDS)])).alias("band", "smallest"),
    )
    known = spark.createDataFrame(
        [(r.license, scales[r.license].size, r.band, r.smallest, r.shingles) for r in bands],
        "license string, size int, band int, smallest bigint, shingles array<string>",
    )
    share = F.size(F.array_intersect("shingles", _shingles(F.col("words")))) / F.size("shingles")
    verified = (
        signed.join(F.broadcast(known), ["size", "band", "smallest"])
        .groupBy("uid", "license")
        .agg(F.max(share).alias("containment"))
        .filter(F.col("containment") >= CONTAINMENT)
    )
    per_row = verified.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("license", "containment"))).alias("licenses")
    )
    empty = F.array().cast("array<struct<license:string,containment:double>>")
    return base.select("uid", "doc_id").join(per_row, "uid", "left").select(
        "doc_id", F.coalesce("licenses", empty).alias("licenses")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = F.transform(
        "licenses",
        lambda x: F.concat_ws(":", x["license"], F.round(x["containment"], 4).cast("string")),
    )
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(named, ",").alias("licenses"),
    )
