"""License scans by canonical digests.

A text and a known license are equal if their canonical forms are: lower case, copyright
lines dropped, punctuation and blanks as single spaces, equivalent spellings as one.
Whole documents and each of their lines are hashed and joined with the known digests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stored, texts

# fixed values: spellings that license texts use for one another
SPELLINGS = [
    ("sub license", "sublicense"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("copyright holder ", "copyright owner "),
    ("merchantibility", "merchantability"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https", "http"),
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—…·•\t\r\f\v "
NOTICE_LINE = r"(?m)^[ \t>#*/]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[{])|(\(c\)|©)[ \t]*(copyright|[0-9]{4}|[<\[{])|all rights reserved[. \t\r]*$)[^\n]*$"  # no line that wrapping begins with "copyright notice"
COPYRIGHT_LINE = r"(?m)^[ \t>#*/]*(copyright|\(c\)|©)[^\n]*$"

# fixed values: published notices and texts (name, text)
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def canonical(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    """Canonical form with line breaks kept; lines are trimmed."""
    out = F.regexp_replace(F.lower(text), dropped, "")
    out = F.translate(out, PUNCTUATION, " " * len(PUNCTUATION))
    out = F.regexp_replace(out, " *\n *", "\n")
    out = F.trim(F.regexp_replace(out, " {2,}", " "))
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))
    return out


def whole(canon: Column) -> Column:
    """Canonical form of an entire text: one line."""
    return F.trim(F.regexp_replace(canon, "\n+", " "))


def joined(canon: Column) -> Column:
    """As ``whole``, with spellings that a line break parted made one too."""
    out = whole(canon)
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def entire_licenses(spark: SparkSession) -> DataFrame:
    """The complete standard texts: each body under each of its titles."""
    with open(Path(__file__).with_name("license_texts.jsonl"), encoding="utf-8") as file:
        entries = [json.loads(line) for line in file]
    rows = [(e["license"], f"{title}\n\n{body}") for e in entries for title in e["titles"] for body in e["bodies"]]
    return spark.createDataFrame(rows, "license string, text string")


def digests(licenses: DataFrame, dropped: str = COPYRIGHT_LINE, line=whole) -> DataFrame:
    """``digest, license``: one row per canonical text (the first name if several share it)."""
    digest = F.unhex(F.sha2(line(canonical(F.col("text"), dropped)).cast("binary"), 256))
    return licenses.filter("text is not null").groupBy(digest.alias("digest")).agg(F.min("license").alias("license"))


def hashed(docs: DataFrame, builtin: bool) -> DataFrame:
    """``row, doc_id, digest, lines, entire, parts``: every row of ``docs`` with the digests of its whole
    text, of its lines, of its text however wrapped and of its paragraphs of several lines. Every
    text is brought to its canonical form once here; what follows works on digests."""
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    notice = canonical(F.col("text"), NOTICE_LINE)
    if builtin:  # words that each of the known texts has
        notice = F.when(F.col("text").rlike("(?i)licen|permission|redistribution|unencumbered|warrant|creative commons"), notice)
    canon = texts(docs).select("doc_id", canonical(F.col("text")).alias("canon"), notice.alias("notice"))
    lines = F.filter(F.split("canon", "\n"), lambda line: line != "")
    parts = F.filter(F.split("notice", "\n{2,}"), lambda part: F.instr(F.trim(part, F.lit("\n")), "\n") > 0)
    return canon.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        digest(whole(F.col("canon"))).alias("digest"),
        F.transform(lines, digest).alias("lines"),
        digest(joined(F.col("notice"))).alias("entire"),
        F.transform(parts, lambda part: digest(joined(part))).alias("parts"),
    )


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, whole_license, licenses, n_lines`` for every row of ``docs``.

    ``whole_license`` names the license whose text the document is; ``licenses`` the
    licenses, by name, that are the document, one of its lines or a paragraph of several
    lines, comma-joined (empty if none); ``n_lines`` counts those lines. Null and empty texts have the digest of an empty
    text, which no license has; rows that share an id, or have none, come out once each by their own
    texts; very long texts are hashed whole. Join strategies follow the size of ``licenses``."""
    spark = docs.sparkSession
    known = digests(known_licenses(spark) if licenses is None else licenses)
    wanted = known_licenses(spark).union(entire_licenses(spark)) if licenses is None else licenses.select("license", "text")
    entire = digests(wanted, NOTICE_LINE, joined)
    facts = stored(hashed(docs, licenses is None), "license_digests")
    lines = facts.select("row", F.explode("lines").alias("digest")).join(known, "digest")
    lines = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_lines"), F.collect_set("license").alias("names"))
    parts = facts.select("row", F.explode("parts").alias("digest")).join(entire, "digest")
    parts = parts.groupBy("row").agg(F.collect_set("license").alias("wrapped"))
    out = facts.select("row", "doc_id", "digest", "entire").join(known.withColumnRenamed("license", "whole_license"), "digest", "left")
    out = out.join(entire.select(F.col("digest").alias("entire"), F.col("license").alias("entire_license")), "entire", "left")
    out = out.join(lines, "row", "left").join(parts, "row", "left")
    out = out.withColumn("whole_license", F.coalesce("whole_license", "entire_license"))
    none = F.array().cast("array<string>")
    names = F.array_union(F.array_union(F.coalesce("names", none), F.coalesce("wrapped", none)), F.when(F.col("whole_license").isNull(), F.array().cast("array<string>")).otherwise(F.array("whole_license")))
    return out.select(
        "doc_id",
        F.lower(F.hex("digest")).alias("digest"),
        "whole_license",
        F.concat_ws(",", F.array_sort(names)).alias("licenses"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
    )


def oracle() -> str:
    """The same in SQL over ``documents``, with the known licenses written out."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, '', 'g')"
        blanks = f"translate({out}, {quote(PUNCTUATION[:-5])} || chr(9) || chr(13) || chr(12) || chr(11) || chr(160), repeat(' ', {len(PUNCTUATION)}))"
        out = f"trim(regexp_replace(regexp_replace({blanks}, ' *' || chr(10) || ' *', chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ')"
        for found, kept in SPELLINGS:
            out = f"replace({out}, {quote(found)}, {quote(kept)})"
        return out

    whole_ = "trim(regexp_replace(canon, chr(10) || '+', ' ', 'g'), ' ')"
    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({whole_}) AS digest, min(license) AS license
  FROM (SELECT license, {canon('text')} AS canon FROM (VALUES {rows}) v(license, text)) GROUP BY 1
), docs AS (SELECT doc_id, {canon("coalesce(text, '')")} AS canon FROM documents),
lines AS (
  SELECT doc_id, license FROM (SELECT doc_id, unnest(string_split(canon, chr(10))) AS line FROM docs) l
  JOIN known ON sha256(line) = digest WHERE line <> ''
), marked AS (
  SELECT doc_id, sha256({whole_}) AS digest, license AS whole_license FROM docs LEFT JOIN known ON sha256({whole_}) = known.digest
), named AS (
  SELECT DISTINCT doc_id, license FROM (SELECT * FROM lines UNION ALL SELECT doc_id, whole_license FROM marked WHERE whole_license IS NOT NULL)
)
SELECT m.doc_id, m.digest, m.whole_license, coalesce(n.names, '') AS licenses, coalesce(c.n, 0) AS n_lines
FROM marked m
LEFT JOIN (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS names FROM named GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) c USING (doc_id)
"""
