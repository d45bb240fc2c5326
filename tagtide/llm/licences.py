"""Finds whole texts that are known licences, by the digest of their canonical form.

The canonical form drops lines that only state a copyright, folds case, spells
equivalent words one way, and keeps letters and digits alone, single-spaced. So
layout, punctuation, quotes, list marks, years and holders make no difference,
and anything else does. Texts and known licences are compared by SHA-256 in a
hash join. All of it is DataFrame functions.

Defined cases: a null or empty text, or one of copyright lines alone, has no
words and matches nothing; of several known licences with one canonical text the
name that sorts first counts; repeated rows are answered each.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm.columns import DOC, carried

# Equivalent spellings, as licence matching guidelines list them; the right side is kept.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub licence": "sublicense", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while",
    "wilful": "wilfull",
}

TEXTS = Path(__file__).parent / "licence_texts"

# Texts by which documents state a licence, and short licences in full.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
}

_COPYRIGHT = "(?i)^[^a-z0-9©]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"
#: A sentence that opens so speaks about copyright; it is no copyright line.
_SENTENCE = "(?i)^[^a-z0-9©]*copyright (holders?|owners?|notices?|laws?)\\b"


def canonical(text: Column) -> Column:
    """The canonical form; empty for a null text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")
    kept = F.filter(lines, lambda line: ~F.rlike(line, F.lit(_COPYRIGHT)) | F.rlike(line, F.lit(_SENTENCE)))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.array_join(kept, "\n")), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    # One pass over the words: names of several words first.
    for old, new in SPELLINGS.items():
        if " " in old:
            words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    single = {old: new for old, new in SPELLINGS.items() if " " not in old}
    table = F.create_map(*(F.lit(x) for pair in single.items() for x in pair))
    any_of = "(?: )(" + "|".join(sorted(single, key=len, reverse=True)) + ")(?= )"
    spelled = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")
    return F.trim(F.when(F.rlike(words, F.lit(any_of)), spelled).otherwise(words))


def digested(docs: DataFrame, own: list[str] | None = None) -> DataFrame:
    """The rows (or their ``own`` columns) as ``_doc`` with n_words and digest of the canonical form; no digest where it has no words."""
    form = F.col("form")
    words = F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1
    return carried(docs, "text", own=own).withColumn("form", canonical(F.col("text"))).select(
        DOC, F.when(form == "", 0).otherwise(words).cast("long").alias("n_words"), F.when(form != "", F.sha2(form, 256)).alias("digest"))


def whole_texts() -> list[tuple[str, str]]:
    """licence and text of the files in ``licence_texts``: LICENCE.txt, and LICENCE__VARIANT.txt for its other wordings."""
    return [(file.stem.split("__")[0], file.read_text("utf-8")) for file in sorted(TEXTS.glob("*.txt"))]


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """licence and text of the licences at hand, or of the given ones."""
    rows = list(texts.items()) if texts else [*KNOWN.items(), *whole_texts()]
    return spark.createDataFrame(rows, "licence string, text string")


def scanned(docs: DataFrame, known: DataFrame, own: list[str] | None = None) -> DataFrame:
    """Every document, or its ``own`` columns, as ``_doc`` with n_words, digest and licence (null: none that is known)."""
    table = digested(known, ["licence"]).where("digest IS NOT NULL").groupBy("digest").agg(F.min(f"{DOC}.licence").alias("licence"))
    return digested(docs, own).join(table, "digest", "left")
