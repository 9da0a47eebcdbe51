"""License scans: TF-IDF cosine of lines to licence templates, then inheritance from the nearest ancestor directory.

A file's own licence is the best match among its lines (a header or a trailing notice is a line); a file that is
called like a licence file, or that consists of its licence line alone, also stands for its directory.  Files
without a licence of their own take that of the nearest directory above them that has one.  Terms are distinct
lower-case words without their punctuation.  Their weights come from all lines: log(1 + lines / (1 + lines with
the term)).  Null and empty texts have no licence of their own; null paths inherit nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import stage

# The wording of common licence notices
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(line: Column) -> Column:
    """Distinct terms of a line."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != ""))


def template_terms(templates: Mapping[str, list[str]]) -> list[tuple[str, str]]:
    """(template, term); a licence with several wordings has several templates, name and number."""
    found = []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            words = {re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()}
            found += [(f"{name}#{k}", w) for w in sorted(words - {""})]
    return found


def line_scores(files: DataFrame, key: str, text: str, templates: Mapping[str, list[str]]) -> DataFrame:
    """(key, line, n_lines, score, license): lines with their cosine to the nearest template, where they share a term.

    Lines are compared in place: their terms meet the templates' terms (a few hundred, fixed) and only sums
    per line go on.  A term that no template has only adds to the line's length.
    """
    spark = files.sparkSession
    pairs = template_terms(templates)
    names = sorted({t for t, _ in pairs})
    vocabulary = spark.createDataFrame([(w, [float((t, w) in set(pairs)) for t in names]) for w in sorted({w for _, w in pairs})], "term string, has array<double>")
    # a number of the row's own keeps equal files apart in the sums
    lines = files.select(F.col(key), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "body")).withColumn("terms", terms(F.col("body")))
    lines = lines.select(key, "row", "line", F.size("terms").alias("n_terms"), "terms")
    hits = lines.select(key, "row", "line", "n_terms", F.explode("terms").alias("term")).join(F.broadcast(vocabulary), "term")  # bounded by the templates
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = files.select(F.sum(F.size(F.split(text, "\n"))).alias("n")).scalar()
    weight = stage(vocabulary.join(frequency, "term", "left").select("term", "has", F.log(1 + F.coalesce(n, F.lit(0)) / (1 + F.coalesce("df", F.lit(0)))).alias("w")), "licence-terms")
    rare = weight.agg(F.max("w")).scalar()
    lengths = weight.select(F.array(*[F.col("has")[k] * F.col("w") * F.col("w") for k in range(len(names))]).alias("x")).select(
        *[F.sqrt(F.sum(F.col("x")[k])).alias(f"t{k}") for k in range(len(names))]).select(F.array(*[f"t{k}" for k in range(len(names))])).scalar()
    weighed = hits.drop("has").join(F.broadcast(weight), "term")  # as many rows as the vocabulary
    sums = weighed.groupBy(key, "row", "line", "n_terms").agg(F.count("*").alias("shared"), F.sum(F.col("w") * F.col("w")).alias("square"),
                                                      *[F.sum(F.col("has")[k] * F.col("w") * F.col("w")).alias(f"t{k}") for k in range(len(names))])
    length = F.sqrt(F.col("square") + (F.col("n_terms") - F.col("shared")) * rare * rare)
    best = F.array_max(F.array(*[F.struct((F.col(f"t{k}") / (length * lengths[k])).alias("score"), F.lit(names[k]).alias("template")) for k in range(len(names))]))
    return sums.withColumn("best", best).select(key, "line", F.col("best.score").alias("score"), F.substring_index("best.template", "#", 1).alias("license"))


def parents(path: Column) -> Column:
    """The directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(
        F.array().cast("array<string>"))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.7, templates: Mapping[str, list[str]] = TEMPLATES) -> DataFrame:
    """``files`` without its text, with ``license``, ``via`` (own, inherited or null), ``license_line`` and ``score``.

    Directories that hold several licence files take the best match, then the first by name.
    """
    of, body = F.col(path), F.col(text)
    rows = files.select(F.struct(*(c for c in files.columns if c != text)).alias("row"), of.alias("name"), F.xxhash64(path, F.xxhash64(text)).alias("file"),
                        (~F.btrim(body, F.lit(" \t\r\n")).contains("\n")).alias("alone"))
    found = line_scores(files.select(F.xxhash64(path, F.xxhash64(text)).alias("file"), body.alias("text")), "file", "text", templates)
    own = stage(found.filter(F.col("score") >= threshold).groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("worst"), "line", "license")).alias("own")), "own-licences")
    name, above_it = F.col("name"), F.size(parents(F.col("name")))
    folder = F.element_at(parents(name), -1)
    stands = name.rlike(LICENCE_FILE) | F.coalesce("alone", F.lit(False))
    folders = rows.select("name", "file", "alone").join(own, "file").filter(stands & (above_it > 0)).groupBy(folder.alias("folder")).agg(
        F.min(F.struct("own.worst", "name", "own.license")).alias("of"))
    folders = stage(folders.select("folder", F.col("of.license").alias("inherits")), "folder-licences")
    # distinct directories, not files, meet the directories above them
    places = rows.filter(above_it > 0).select(folder.alias("place")).distinct()
    above = places.select("place", F.posexplode(F.array_append(parents(F.col("place")), F.col("place"))).alias("depth", "folder"))
    nearest = above.join(folders, "folder").groupBy("place").agg(F.max(F.struct("depth", "inherits")).alias("near"))
    out = rows.withColumn("under", F.when(above_it > 0, folder)).join(own, "file", "left").join(nearest, F.col("under") == F.col("place"), "left")
    inherited = F.col("near.inherits")
    made = out.select("row", F.coalesce("own.license", inherited).alias("_license"), F.when(F.col("own").isNotNull(), "own").when(inherited.isNotNull(), "inherited").alias("_via"),
                      F.col("own.line").alias("_line"), F.round(-F.col("own.worst"), 6).alias("_score"))
    kept = [F.col("row")[c].alias(c) for c in files.columns if c not in (text, "license", "via", "license_line", "score")]
    return made.select(*kept, F.col("_license").alias("license"), F.col("_via").alias("via"), F.col("_line").alias("license_line"), F.col("_score").alias("score"))
