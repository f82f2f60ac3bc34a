"""Licence scans by recognising sentences: DataFrame functions only, no shuffle.

A text is cut into sentences at blank lines (also those of a comment, without letters and digits) and after full
stops, exclamation and question marks followed by white space; a single line feed is white space, so notices may be
wrapped and stand in comments, and semicolons stand within known sentences. Each sentence is normalised (lower case,
anything but letters and digits to one space) and looked up in a map of titles; else every known licence sentence in it
counts, wherever it begins, and is mapped to its identifier. The identifiers found, in order of the text, are then matched
against ordered rules, each a sequence of identifiers that must occur in that order, gaps allowed; a document gets every
rule that holds and, as its licence, the first of them.

The maps hold one entry a known sentence and are written into the plan: they are bounded by the catalogue, not by data.

Defined results: a null or empty text has no sentences, no identifiers and no licence; repeated rows and null keys
are rows of their own; a text of any length and any number of sentences is read whole, without recursion; other columns
of any name are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keyed, table

#: Known licence sentences in normalised form, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0/notice",
    "you may not use this file except in compliance with the license": "apache-2.0/compliance",
    "you may obtain a copy of the license at": "apache-2.0/copy",
    "released under the mit license": "mit/notice",
    "licensed under the mit license": "mit/notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit/grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit/condition",
    "the software is provided as is without warranty of any kind": "mit/warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0/notice",
    "this program is free software you can redistribute it and or modify": "gpl/free",
    "under the terms of the gnu general public license as published by": "gpl/terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0/version",
    "either version 2 of the license or at your option any later version": "gpl-2.0/version",
    "this program is distributed in the hope that it will be useful": "gpl/useful",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0/notice",
    "licensed under cc by 4 0": "cc-by-4.0/notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0/notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0/notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0/notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd/grant",
    "redistributions of source code must retain the above copyright notice": "bsd/source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd/binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd/names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0/notice",
    "all rights reserved": "reserved",
    "this is free and unencumbered software released into the public domain": "unlicense/notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc/grant",
    "under the terms of the gnu lesser general public license": "lgpl/terms",
    "either version 2 1 of the license or at your option any later version": "lgpl-2.1/version",
    "under the terms of the gnu affero general public license": "agpl/terms",
    "distributed under the boost software license version 1 0": "bsl-1.0/notice",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib/altered",
    "licensed under the eclipse public license v 2 0": "epl-2.0/notice",
}
#: Sentences that count only as a whole, such as the title above a licence.
TITLES = {
    "mit license": "mit/title", "the mit license": "mit/title", "the mit license mit": "mit/title", "isc license": "isc/title", "the isc license": "isc/title",
    "bsd 2 clause license": "bsd-2-clause/title", "bsd 3 clause license": "bsd-3-clause/title", "apache license version 2 0": "apache-2.0/title",
    "mozilla public license version 2 0": "mpl-2.0/title", "boost software license version 1 0": "bsl-1.0/title", "the unlicense": "unlicense/title",
}
#: Licences by their SPDX identifiers, as they stand in machine-readable tags; longer ones ("-or-later") begin with these.
TAGS = (
    "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
    "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Zlib", "BSL-1.0", "EPL-2.0", "0BSD",
)
SENTENCES |= {"spdx license identifier " + tag.lower().replace("-", " ").replace(".", " "): f"tag/{tag.lower()}" for tag in TAGS}
#: Ordered rules: (licence, identifiers that must occur in this order). The first that holds names the document.
RULES = (
    *((tag, (f"tag/{tag.lower()}",)) for tag in TAGS),
    ("AGPL-3.0", ("gpl/free", "agpl/terms", "gpl-3.0/version")),
    ("LGPL-3.0", ("gpl/free", "lgpl/terms", "gpl-3.0/version")),
    ("LGPL-2.1", ("gpl/free", "lgpl/terms", "lgpl-2.1/version")),
    ("GPL-3.0", ("gpl-3.0/notice",)),
    ("GPL-3.0", ("gpl/free", "gpl/terms", "gpl-3.0/version")),
    ("GPL-2.0", ("gpl/free", "gpl/terms", "gpl-2.0/version")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0/notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0/notice",)),
    ("CC-BY-4.0", ("cc-by-4.0/notice",)),
    ("MPL-2.0", ("mpl-2.0/notice",)),
    ("MPL-2.0", ("mpl-2.0/title",)),
    ("Apache-2.0", ("apache-2.0/notice",)),
    ("Apache-2.0", ("apache-2.0/title",)),
    ("Apache-2.0", ("apache-2.0/compliance", "apache-2.0/copy")),
    ("MIT", ("mit/notice",)),
    ("MIT", ("mit/title",)),
    ("MIT", ("mit/grant", "mit/condition")),
    ("ISC", ("isc/grant",)),
    ("ISC", ("isc/title",)),
    ("BSD-3-Clause", ("bsd/grant", "bsd/source", "bsd/binary", "bsd/names")),
    ("BSD-3-Clause", ("bsd-3-clause/title",)),
    ("BSD-2-Clause", ("bsd/grant", "bsd/source", "bsd/binary")),
    ("BSD-2-Clause", ("bsd-2-clause/title",)),
    ("BSL-1.0", ("bsl-1.0/notice",)),
    ("BSL-1.0", ("bsl-1.0/title",)),
    ("Zlib", ("zlib/altered",)),
    ("EPL-2.0", ("epl-2.0/notice",)),
    ("Unlicense", ("unlicense/notice",)),
    ("Unlicense", ("unlicense/title",)),
    ("Proprietary", ("reserved",)),
)
#: Words of which every known sentence holds one: a text without any has no known sentence.
_KEYWORDS = ("licen", "permi", "redistribut", "copyright", "provided as is", "free software", "hope that it will", "rights reserved", "unencumbered", "source versions must be")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Array of the text's sentences. A mark at the beginning of a line is a comment's; that of "v. 2.0" ends nothing."""
    return F.split(text, r"\n[^\p{L}\p{N}\n]*+\n|(?<=[^\s.!?][.!?])(?<!\b[Vv]\.)\s+")


def _keyword(text: Column) -> Column:
    """Might it hold a known sentence? Only spaces differ between a sentence and its normal form, so single words
    decide; those of several words are compared with any run of other characters between."""
    return F.lower(text).rlike("|".join(k.replace(" ", "[^a-z0-9]+") for k in _KEYWORDS))


def _known(sentence: Column, known: dict[str, str]) -> Column:
    """The known sentences in a normalised sentence, by where they begin; of those that begin together the longest."""
    words = "|".join(sorted(known, key=lambda w: -len(w)))
    return F.regexp_extract_all(sentence, F.lit(rf"\b(?=({words})\b)"), 1)


def _in_order(found: Column, sequence: tuple[str, ...]) -> Column:
    """Do the identifiers occur in this order, gaps allowed? One walk over those found, whatever their number."""
    if len(sequence) == 1:
        return F.array_contains(found, sequence[0])
    wanted = F.array(*map(F.lit, sequence))
    return F.aggregate(found, F.lit(0), lambda k, x: F.when(F.get(wanted, k) == x, k + 1).otherwise(k)) == len(sequence)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, str] | None = None, rules: tuple = RULES, titles: dict[str, str] | None = None) -> DataFrame:
    """doc_id, identifiers (in order of the text), licences (all rules that hold, in rule order) and licence."""
    known, titles = SENTENCES if known is None else known, TITLES if titles is None else titles
    out = keyed(docs, key, text)
    # Of all sentences only those with a keyword are normalised and compared.
    cut = F.transform(F.filter(sentences(F.col("text")), _keyword), normalised)
    names, whole = (F.create_map(*(F.lit(x) for pair in entries.items() for x in pair)) for entries in (known, titles))
    within = lambda s: F.transform(_known(s, known), lambda w: names[w])
    found = F.flatten(F.transform(cut, lambda s: F.when(whole[s].isNotNull(), F.array(whole[s])).otherwise(within(s))))
    found = F.when(_keyword(F.col("text")), found).otherwise(F.array().cast("array<string>"))
    out = out.select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("identifiers"))
    held = F.array(*(F.when(_in_order(F.col("identifiers"), seq), F.lit(name)) for name, seq in rules))
    licences = F.when(F.size("identifiers") > 0, F.array_distinct(F.array_compact(held))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("licences", licences)
    return out.withColumn("licence", F.try_element_at("licences", F.lit(1)))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("identifiers").cast("long").alias("n_sentences"), F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"), "licence")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    values = lambda entries: ", ".join(f"({_quoted(w)}, {_quoted(i)})" for w, i in entries.items())
    order = lambda seq: "regexp_matches(x, " + _quoted("(^|#)" + "#(.*#)?".join(i.replace(".", "[.]") for i in seq) + "(#|$)") + ")"
    held = ", ".join(f"CASE WHEN {order(seq)} THEN {_quoted(name)} END" for name, seq in RULES)
    space = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH known(w, id) AS (VALUES {values(SENTENCES)}), titles(w, id) AS (VALUES {values(TITLES)}),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n', chr(1), 'g'),
           '(\\b[Vv]\\.){space}+', '\\1' || chr(2), 'g'), '([^ \\t\\n\\x0B\\f\\r.!?][.!?]){space}+', '\\1' || chr(1), 'g') AS t FROM documents),
parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS j FROM (SELECT doc_id, string_split(t, chr(1)) AS p FROM marked)),
normal AS (SELECT doc_id, j, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
places AS (SELECT doc_id, j, s, w, id, unnest(list_filter(range(1, CAST(len(s) + 1 AS BIGINT)), lambda i: substr(' ' || s || ' ', i, len(w) + 2) = ' ' || w || ' ')) AS i
           FROM normal JOIN known ON contains(' ' || s || ' ', ' ' || w || ' ')),
ids AS (SELECT doc_id, j, i, arg_max(id, len(w)) AS id FROM places WHERE s NOT IN (SELECT w FROM titles) GROUP BY doc_id, j, i
        UNION ALL SELECT doc_id, j, 0, id FROM normal JOIN titles ON s = w),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY j, i) AS identifiers, string_agg(id, '#' ORDER BY j, i) AS x FROM ids GROUP BY doc_id),
held AS (SELECT doc_id, n, identifiers, list_filter([{held}], lambda v: v IS NOT NULL) AS h FROM found),
once AS (SELECT doc_id, n, identifiers, list_filter(h, lambda v, k: list_position(h, v) = k) AS h FROM held)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(identifiers, '') AS identifiers, coalesce(array_to_string(h, ','), '') AS licences, h[1] AS licence
FROM documents d LEFT JOIN once USING (doc_id)"""


ORACLE = {"op7_licences": _oracle()}
QUERIES = {"op7_licences": op7_licences}
