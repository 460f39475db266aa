"""Licence scans by canonical digests (operator 3).

Entire texts are normalised (lower case, copyright lines out, punctuation and white space to single spaces,
equivalent spellings to one) and their SHA-256 is joined to the digests of known licence texts.  The same is
done for every line that names a licence, against known one-line notices, so that a notice inside a document
is found as an entire text of its own.  Only digests are compared; the known texts are a small fixed table, or
one that the caller gives.

The fixed table has the entire texts in ``licenses/`` (with and without what follows the terms), those of MIT,
ISC and 0BSD below, and the standard headers of Apache-2.0, MPL-2.0, GPL-2.0, GPL-3.0 and LGPL-2.1.  It has no
entire text of AGPL-3.0, CC-BY-4.0, CC-BY-NC-4.0 and EPL-2.0: these are found by one-line notices only, unless the
caller gives their texts.  A header of several lines is found where it is the whole document or stands on one
line, and by those of its lines that name one licence only (Apache-2.0, MPL-2.0).

Defined results.  Null text is empty and matches nothing known.  Of licences with one canonical text the
least name is given.  Null ids keep their row; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_row

#: Words after "copyright" or a sign that go on with a sentence instead of naming a year or holder, as where a text is wrapped there.
_SENTENCE = r"(?:(?:notice|holder|owner|ownership|law|license|licence|line|statement|interest|treat(?:y|ie)|permission|disclaimer|doctrine|claim|protection|right)s?|also|and|or|are|is|if|in|of|on|to|for|from|any|all|as|at|an?|under|you|your|including|like|more|patent|related|similar|resulting|then|that|this|those|these|which|must|shall|may|not|(?:the|its) (?:software|program|work|library|licensor|licensed|source|original|covered|above|following|copyright))\b"
#: Lines that state who holds the copyright, in lower case.
COPYRIGHT = rf"^[^a-z0-9]*(?:all rights reserved|(?:copyright[^\p{{L}}\p{{N}}]*)?©|(?:copyright[^\p{{L}}\p{{N}}]*)?\(c\)[^\p{{L}}\p{{N}}]*(?:$|(?!{_SENTENCE})[\p{{L}}\p{{N}}])|copyright(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*(?!{_SENTENCE})[\p{{L}}\p{{N}}])"
#: The same without looking ahead, for the SQL: (a line has, but has not).
_SIGN, _WORD = r"^[^a-z0-9]*(?:copyright[^\p{L}\p{N}]*)?\(c\)[^\p{L}\p{N}]*", r"^[^a-z0-9]*copyright[^\p{L}\p{N}]+"
SQL_COPYRIGHT = ((r"^[^a-z0-9]*(?:all rights reserved|(?:copyright[^\p{L}\p{N}]*)?©)", None), (_SIGN + r"(?:$|[\p{L}\p{N}])", _SIGN + _SENTENCE), (_WORD + r"[\p{L}\p{N}]", _WORD + _SENTENCE))
#: Lines that a notice can be; every known notice has one of these words.
NAMES_A_LICENSE = r"(?i)licen[cs]|public domain"
#: Equivalent spellings, over canonical words.
SPELLINGS = (
    (r"\b(sub)?licence(s|d)?\b", "{1}license{2}"),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\borganis", "organiz"),
    (r"\bauthoris", "authoriz"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bwilful", "willful"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfavour", "favor"),
    (r"\bwhilst\b", "while"),
    (r"\bhttps\b", "http"),
)

#: Identifier, and the names that notices use.
LICENSES = (
    ("0BSD", ("Zero-Clause BSD License", "0BSD License")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPL 3.0", "AGPLv3")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons Zero License")),
    ("EPL-2.0", ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPL 2.0", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPL 3.0", "GPLv3")),
    ("ISC", ("ISC License",)),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "LGPL 2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL 3.0", "LGPLv3")),
    ("MIT", ("MIT License",)),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0")),
    ("Unlicense", ("Unlicense", "The Unlicense")),
    ("Zlib", ("zlib License",)),
)
NOTICES = ("Licensed under {0}", "Licensed under the {0}", "Released under {0}", "Released under the {0}", "Distributed under the {0}", "This work is licensed under {0}", "This work is licensed under the {0}", "This software is licensed under the {0}", "SPDX-License-Identifier: {1}")

# Short licence texts.
_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEXTS = (
    ("MIT", _PERMISSION),
    ("MIT", "MIT License\n\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n\n" + _PERMISSION),
    ("ISC", _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", _USE + ".\n\n" + _ISC_WARRANTY),
)
#: Where the standard header stands in an entire text: its first and last words.
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License", "limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms", "http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This program is free software; you can", "MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can", "<https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software; you can", "USA"),
)
#: Lines of headers that name one licence by themselves.
HEADER_LINES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
)
_END = "END OF TERMS AND CONDITIONS"


def entire() -> list[tuple[str, str]]:
    """(license, text): the files' texts, with and without what follows the terms, and their headers."""
    files = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    out = list(files.items())
    for i, text in files.items():
        if _END in text:
            out += [(i, text[: text.index(_END)]), (i, text[: text.index(_END) + len(_END)])]
        out += [(i, f"{name}\n\n{text}") for name in dict(LICENSES)[i]]
    for i, first, last in HEADERS:
        start = files[i].index(first)
        out.append((i, files[i][start : files[i].index(last, start) + len(last)]))
    return out


def known_texts() -> list[tuple[str, str]]:
    """(license, text): the texts above, those of the files, and the notices by rule."""
    notices = [(i, n.format(name, i)) for i, names in LICENSES for name in names for n in NOTICES]
    return [*TEXTS, *entire(), *HEADER_LINES, *dict.fromkeys(notices)]


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license string, text string")


def _java(replacement: str) -> str:
    return replacement.replace("{1}", "$1").replace("{2}", "$2")


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    words = F.trim(F.regexp_replace(F.array_join(lines, " "), r"[^\p{L}\p{N}]+", " "))
    any_spelling = "|".join(p for p, _ in SPELLINGS)
    one = reduce(lambda c, p: F.regexp_replace(c, p[0], _java(p[1])), SPELLINGS, words)
    return F.when(words.rlike(any_spelling), one).otherwise(words)


def _digests(texts: DataFrame) -> DataFrame:
    """(license, digest), one per digest; a text of no words is no licence."""
    words = canonical(F.col("text"))
    return texts.where(words != "").groupBy(F.sha2(words, 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, _row, digest of the canonical text, license of the entire text, notices (line from 1, license)."""
    digests = _digests(known(docs.sparkSession) if texts is None else texts)
    rows = with_row(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    whole = rows.select("doc_id", "_row", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(digests, "digest", "left")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("body")))
    named = rows.where(F.col("text").rlike(NAMES_A_LICENSE)).select("_row", F.explode(F.filter(lines, lambda x: x["body"].rlike(NAMES_A_LICENSE))).alias("l"))
    met = named.select("_row", "l.line", F.sha2(canonical(F.col("l.body")), 256).alias("digest")).join(digests, "digest")
    notices = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("line", "license"))).alias("notices"))
    return whole.join(notices, "_row", "left").select("doc_id", "_row", "digest", "license", F.coalesce("notices", F.array().cast("array<struct<line:int,license:string>>")).alias("notices"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["line"].cast("string"), x["license"])), ",")
    return out.select("doc_id", F.col("digest").alias("canonical_sha256"), "license", F.size("notices").cast("long").alias("n_notices"), listed.alias("notices"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(c: str) -> str:
    states = " OR ".join(f"(regexp_matches(x, {_sql_text(has)})" + (f" AND NOT regexp_matches(x, {_sql_text(has_not)})" if has_not else "") + ")" for has, has_not in SQL_COPYRIGHT)
    words = f"trim(regexp_replace(array_to_string(list_filter(string_split(lower({c}), chr(10)), lambda x: NOT ({states})), ' '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, replacement in SPELLINGS:
        words = f"regexp_replace({words}, {_sql_text(pattern)}, {_sql_text(replacement.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    return words


_KNOWN = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in dict.fromkeys(known_texts()))
SQL = f"""
    WITH c AS (SELECT license, {_sql_canonical("text")} AS words FROM (VALUES {_KNOWN}) t(license, text)),
    k AS (SELECT sha256(words) AS digest, min(license) AS license FROM c WHERE words <> '' GROUP BY 1),
    d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT row, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
    n AS (SELECT row, line, sha256({_sql_canonical("body")}) AS digest FROM l WHERE regexp_matches(body, '{NAMES_A_LICENSE}')),
    m AS (SELECT row, count(*) AS n, string_agg(line || ':' || license, ',' ORDER BY line) AS listed FROM n JOIN k USING (digest) GROUP BY row),
    w AS (SELECT row, doc_id, sha256({_sql_canonical("text")}) AS digest FROM d)
    SELECT doc_id, w.digest AS canonical_sha256, license, coalesce(n, 0) AS n_notices, coalesce(listed, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN m USING (row)
"""
