"""Op 8: licence scan by lookup of canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines, equivalent
spellings), and the digest of the whole form is joined with the digests of known licences. The lines
of a text are looked up in the same way, each as a text of its own, for notices within a document.
Titles at the start of a text do not count for the lookup of the whole.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens.llm.tables import prepare
from podlens.session import small_side

# Licence texts and notices as they are commonly printed; further whole texts are in the folder
# ``licenses``. A licence table of one's own, with columns license_id and text, takes their place or adds to them.
KNOWN_LICENSES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}

# Spellings that licence comparison treats as one.
EQUIVALENT_WORDS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "labelled": "labeled",
    "labelling": "labeling",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "per cent": "percent",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
# A copyright line names a year or has the sign; other lines that begin so are part of the wrapped text.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(?:©|\(c\)[ \t]*(?:copyright\b|©|[0-9]{4}\b)"
    r"|copyright[ \t:,]*(?:©|\(c\)|[0-9]{4}\b|[<\[{](?:year|yyyy))"
    r"|copyright(?![ \t]+(?:notices?|holders?|owners?|acts?|laws?|treaty|licen[cs]es?|and|or|on|in|of)\b)"
    r"[ \t][^\n]{0,80}\b(?:19|20)[0-9]{2}\.?[ \t]*(?=\n|$))[^\n]*"
)
# Title lines, in canonical form. They are left out when a whole text is looked up.
TITLES = (
    r"^[ \n]*(?:(?:(?:the )?(?:mit(?: x11)?|x11|expat|isc|bsd(?: [0-9] clause)?|[0-9] clause bsd"
    r"|(?:new|modified|revised|simplified|free)(?: [0-9] clause)? bsd|apache|mozilla public|boost software|zlib"
    r"|artistic|gnu (?:lesser |library |affero )?general public|gnu free documentation) license(?: [a-z0-9]+){0,6}"
    r"|(?:the )?(?:mit|isc|zlib|bsd [0-9] clause|unlicense)) \n )+"
)
ALL_RIGHTS_LINE = r"(^|\n)[ \t]*all rights reserved\.?[ \t]*(\n|$)"


def canonical(text: str) -> Column:
    """The canonical form: words of letters and digits in lower case and in one spelling; lines are kept."""
    form = F.lower(F.coalesce(F.col(text), F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT_LINE, "\n")
    form = F.regexp_replace(form, ALL_RIGHTS_LINE, "\n")
    form = F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " ")
    form = F.regexp_replace(form, r" ?\n[ \n]*", " \n ")
    form = F.concat(F.lit(" "), form, F.lit(" "))
    for variant, usual in EQUIVALENT_WORDS.items():
        form = F.replace(form, F.lit(f" {variant} "), F.lit(f" {usual} "))
    return form


def whole_digest(form: str) -> Column:
    return F.sha2(F.btrim(F.replace(F.col(form), F.lit(" \n "), F.lit(" "))), 256)


def lookup_digest(form: str) -> Column:
    """The digest of the whole form without title lines at its start."""
    body = F.regexp_replace(F.col(form), TITLES, "")
    return F.sha2(F.btrim(F.replace(body, F.lit(" \n "), F.lit(" "))), 256)


def line_digests(form: str) -> Column:
    lines = F.transform(F.split(F.col(form), "\n"), lambda line: F.btrim(line))
    return F.transform(F.array_distinct(F.filter(lines, lambda line: line != "")), lambda line: F.sha2(line, 256))


def license_digests(licenses: DataFrame) -> DataFrame:
    """Digest and name of known licences; of licences with one form the first name counts."""
    rows = licenses.select("license_id", canonical("text").alias("form"))
    rows = rows.groupBy(lookup_digest("form").alias("license_digest")).agg(F.min("license_id").alias("license_id"))
    return rows.filter(F.col("license_digest") != F.sha2(F.lit("").cast("binary"), 256))


def license_texts() -> list[tuple[str, str]]:
    """Names and whole texts of the licences in ``licenses``, with the variants that are in common use."""
    out = []
    for file in sorted((resources.files("podlens.llm") / "licenses").iterdir(), key=lambda file: file.name):
        if not file.name.endswith(".txt"):
            continue
        name, texts = file.name.removesuffix(".txt"), [file.read_text("utf-8")]
        # Without the appendix on how to apply the licence, and without the line before that.
        body, end, _ = texts[0].partition("END OF TERMS AND CONDITIONS")
        texts += [body + end, body] if end else []
        if name.startswith("BSD-"):
            texts += [re.sub(r"(?m)^[0-9]\. ", "* ", text) for text in texts]
            texts += [text.replace("SHALL THE COPYRIGHT HOLDER", "SHALL THE COPYRIGHT OWNER") for text in texts]
        out += [(name, text) for text in texts]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN_LICENSES.items(), *license_texts()], "license_id string, text string")


def scan_licenses(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` of the canonical whole text, ``license_id`` if that, but for titles, is a known
    licence, and ``line_licenses``: the sorted names of licences that lines of the text are (an array, maybe empty).

    ``docs`` has ``doc_id`` and ``text``, ``licenses`` has ``license_id`` and ``text``; other columns
    are not read. A text without a word in canonical form (null, empty, copyright lines alone) has a
    null licence and the digest of the empty form. A text of one line is looked up both ways. Rows that
    repeat give equal rows. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical("text").alias("form"))
    digests = F.concat(F.array(whole_digest("form"), lookup_digest("form")), line_digests("form"))
    # All digests of a text are in one task, which brings them back to one row before the shuffle.
    looked_up = rows.select("row", "doc_id", F.posexplode(digests).alias("at", "digest"))
    known = small_side(license_digests(licenses))
    found = looked_up.join(known, F.col("digest") == F.col("license_digest"), "left")
    whole, body, line = F.col("at") == 0, F.col("at") == 1, F.col("at") > 1
    return found.groupBy("row", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(body, F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(line, F.col("license_id")))).alias("line_licenses"),
    ).drop("row")
