"""Licence detection by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory.

All of it is DataFrame operations. A file's candidates are its header, each line and each sentence that speaks of a
licence, and the whole text of a licence file. Each becomes a vector of term weights of its own, so that other words
beside a notice do not hide it, and is compared with every template by joining on terms, of which the templates have a
bounded number; the best candidate counts. Templates are notices, identifiers and whole licences. A licence file's directory passes its licence to the files below it that have none of their own: a file's ancestor
directories are joined to licensed directories by path, and the deepest match counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written
from .registry import query

# Notices by which licences are known.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial 4.0 International.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. The Unlicense.",
}

# Other notices, and the text of whole licences.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "ISC": "Released under the ISC License.",
    "MIT": "Released under the MIT License.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}
WHOLE = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def all_templates() -> list[tuple[int, str, str]]:
    """(number, licence, text) of notices, identifiers and whole licences."""
    identifiers = {name: f"SPDX-License-Identifier: {name}" for name in TEMPLATES}
    pairs = [pair for some in (TEMPLATES, NOTICES, WHOLE, identifiers) for pair in some.items()]
    return [(i, *pair) for i, pair in enumerate(pairs)]


#: Least cosine of a match; digits that cosines are rounded to, so that the order of sums cannot show.
LEAST, DIGITS = 0.35, 6
#: A line that speaks of a licence.
MARKED = r"licen[sc]e|spdx|copyright|public domain|creative commons|permission is hereby|redistribution and use"
SENTENCE_END = r"[.!?;] "
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense)(?:[._-].*)?$"


def terms(text: Column) -> Column:
    """Words of ASCII letters and digits, lower-cased; version numbers stay whole."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def candidates(text: Column, names_folder: Column) -> Column:
    """What of a file is compared: its header up to the first empty line, every line and sentence that speaks of a
    licence, wherever it stands, and the whole text of a licence file; each different one once."""
    marked = lambda some: F.filter(some, lambda x: ascii_lower(x).rlike(MARKED))
    header = F.slice(F.split(text, "\n\n"), 1, 1)
    lines = marked(F.split(text, "\n"))
    sentences = marked(F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_END))))
    whole = F.when(names_folder, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(marked(header), lines, sentences, whole)), lambda x: x != "")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def template_weights(templates: DataFrame) -> DataFrame:
    """(template, licence, term, idf, weight): unit vectors of TF-IDF; idf = ln((1 + N) / (1 + df)) + 1 over the templates."""
    counts = term_counts(templates, "template", "body")
    n = templates.count()
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf")
    )
    raw = counts.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weights = raw.join(norm, "template").select("template", "term", "idf", (F.col("raw") / F.col("norm")).alias("weight"))
    return weights.join(templates.select("template", "licence"), "template")


def best_match(notice: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(notice, licence, cosine): the nearest template of each distinct notice (notice, body), ties to the first name.

    A term that no template has gets the idf of df = 0 and counts in the notice's length.
    """
    weights = F.broadcast(template_weights(templates))  # templates are a short fixed list
    unseen = F.lit(math.log(1.0 + templates.count()) + 1)
    counts = term_counts(notice, "notice", "body")
    known = weights.select("term", "idf").distinct()
    scaled = counts.join(F.broadcast(known), "term", "left").withColumn("raw", F.col("tf") * F.coalesce("idf", unseen))
    norm = scaled.groupBy("notice").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    dots = (
        scaled.select("notice", "term", "raw")
        .join(weights.select("term", "template", "licence", "weight"), "term")
        .groupBy("notice", "template", "licence")
        .agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / F.col("norm"), DIGITS)
    scored = dots.join(norm, "notice").select("notice", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("licence").alias("licence")))
    return scored.groupBy("notice").agg(best.alias("b")).select(
        "notice", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine")
    )


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the root included, with their depth."""
    parts = F.split(folder, "/")
    depths = F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts)))
    return F.transform(
        depths, lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("folder"), d.alias("depth"))
    )


def licence_scan(
    files: DataFrame, templates: DataFrame, path: str = "path", text: str = "text", key: str = "file_id"
) -> DataFrame:
    """(key, path, licence, cosine, source) for each row of ``files``: source is own, inherited or none.

    A null path is a file in the root without a name; null and empty texts have no notice. Of several licence files in
    a directory the one with the greatest cosine counts, and so it goes for the candidates of a file, ties to the first
    licence. Repeated rows come back each. Candidates repeat, so each distinct one is matched once; directories are
    joined once each, however many files they hold.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit(""))
    names_folder = F.regexp_extract(where, "[^/]*$", 0).rlike(LICENCE_FILE)
    base = files.select(
        F.col(f"`{key}`").alias("file"),
        where.alias("path"),
        candidates(body, names_folder).alias("candidates"),
        directory(where).alias("folder"),
        names_folder.alias("names_folder"),
        F.monotonically_increasing_id().alias("rid"),
    )
    # texts are read once, and only what is compared is kept of them
    base = written(base, "licence-files", "zstd")
    # beyond the first count candidates go by a digest of 128 bits, so that no text is shuffled with each of its terms
    notice = base.select("rid", F.explode("candidates").alias("body")).withColumn("notice", F.unhex(F.md5("body")))
    counted = written(notice.groupBy("notice").agg(F.first("body").alias("body"), F.count("*").alias("n")), "licence-notices", "zstd")
    notice = notice.drop("body")
    matched = written(best_match(counted.select("notice", "body"), templates).join(counted.drop("body"), "notice"), "licence-matches")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # notices that crowd a task number at most a thousand and join by broadcast
    frequent = F.col("n") * 1000 > total
    hot = F.broadcast(matched.where(frequent).select("notice", "licence", "cosine"))
    often = counted.where(frequent).select("notice")
    rare = notice.join(F.broadcast(often), "notice", "left_anti").join(matched.where(~frequent).select("notice", "licence", "cosine"), "notice")
    found = notice.join(hot, "notice").unionByName(rare)
    strongest = F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("licence").alias("licence")))
    best = found.groupBy("rid").agg(strongest.alias("b")).select(
        "rid", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine")
    )
    # most files have no notice; they need no join
    silent = F.size("candidates") == 0
    slim = base.drop("candidates")
    none = base.where(silent).drop("candidates").select(
        "*", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("cosine")
    )
    own = base.where(~silent).select(*slim.columns).join(best, "rid", "left").unionByName(none)
    own = written(own, "licence-own")
    licensed = (
        own.where("names_folder and licence is not null")
        .groupBy("folder")
        .agg(strongest.alias("b"))
        .select(F.col("folder").alias("above"), F.col("b.licence").alias("folder_licence"), (-F.col("b.minus")).alias("folder_cosine"))
    )
    # every folder once, with its ancestors
    folders = base.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
    deepest = F.max(F.struct(F.col("a.depth").alias("depth"), F.col("folder_licence"), F.col("folder_cosine")))
    inherited = (
        folders.join(licensed, F.col("a.folder") == F.col("above"))
        .groupBy("folder")
        .agg(deepest.alias("d"))
        .select("folder", F.col("d.folder_licence").alias("from_licence"), F.col("d.folder_cosine").alias("from_cosine"))
    )
    return own.join(inherited, "folder", "left").select(
        F.col("file").alias(key),
        "path",
        F.coalesce("licence", "from_licence", F.lit("none")).alias("licence"),
        F.coalesce("cosine", "from_cosine", F.lit(0.0)).alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("from_licence").isNotNull(), "inherited").otherwise("none").alias("source"),
    )


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(all_templates(), "template int, licence string, body string")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/hundred/name, a text that ends in a notice being its folder's licence file."""
    last = F.substring_index(F.rtrim(F.coalesce("text", F.lit(""))), "\n", -1)
    name = F.when(ascii_lower(last).rlike(r"licen[sc]e"), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string")))
    name = F.coalesce(name, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", hundred, name).alias("path"))


def _sql() -> str:
    quoted = [(i, name, body.replace("'", "''")) for i, name, body in all_templates()]
    values = ", ".join(f"({i}, '{name}', '{body}')" for i, name, body in quoted)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = r"regexp_extract_all({}, '[a-z0-9]+(?:\.[0-9]+)*')"
    marked = f"list_filter({{}}, lambda x: regexp_matches({lower.format('x')}, '{MARKED}'))"
    n = len(quoted)
    return f"""
WITH t(template, licence, body) AS (VALUES {values}),
tc AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({found.format(lower.format('body'))}) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {n}) / (1.0 + count(*))) + 1 AS idf FROM tc GROUP BY term),
tr AS (SELECT template, licence, term, tf * idf AS raw FROM tc JOIN idf USING (term)),
tw AS (SELECT template, licence, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY template)) AS weight FROM tr),
d AS (SELECT doc_id,
  concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), CASE WHEN regexp_matches({lower.format("regexp_extract(rtrim(text, ' '), '[^' || chr(10) || ']*$')")}, 'licen[sc]e')
    THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path,
  coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}') AS names_folder,
  {marked.format("string_split(text, chr(10))")} AS lines FROM d),
c AS (SELECT DISTINCT doc_id, notice FROM (SELECT doc_id, unnest(list_concat({marked.format("string_split(text, chr(10) || chr(10))[1:1]")}, lines,
  {marked.format(f"flatten(list_transform(lines, lambda y: string_split_regex(y, '{SENTENCE_END}')))")}, CASE WHEN names_folder THEN [text] ELSE [] END)) AS notice FROM b) u WHERE notice <> ''),
n AS (SELECT DISTINCT notice FROM c),
nc AS (SELECT notice, term, count(*) AS tf FROM (SELECT notice, unnest({found.format(lower.format('notice'))}) AS term FROM n) GROUP BY ALL),
nr AS (SELECT notice, term, tf * coalesce(idf, ln(1.0 + {n}) + 1) AS raw FROM nc LEFT JOIN idf USING (term)),
nn AS (SELECT notice, sqrt(sum(raw * raw)) AS norm FROM nr GROUP BY notice),
sc AS (SELECT notice, template, licence, round(sum(raw * weight) / any_value(norm), {DIGITS}) AS cosine FROM nr JOIN tw USING (term) JOIN nn USING (notice) GROUP BY ALL),
m AS (SELECT doc_id, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine FROM sc JOIN c USING (notice) WHERE cosine >= {LEAST} GROUP BY doc_id),
o AS (SELECT b.*, m.licence, m.cosine FROM b LEFT JOIN m USING (doc_id)),
l AS (SELECT folder AS above, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine FROM o WHERE names_folder AND licence IS NOT NULL GROUP BY folder),
f AS (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS depth FROM (SELECT DISTINCT folder FROM b)),
i AS (SELECT f.folder, arg_max(l.licence, depth) AS licence, arg_max(l.cosine, depth) AS cosine FROM f
  JOIN l ON array_to_string(string_split(f.folder, '/')[1:depth], '/') = l.above GROUP BY f.folder)
SELECT doc_id, path, coalesce(o.licence, i.licence, 'none') AS licence, coalesce(o.cosine, i.cosine, 0.0) AS cosine,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN i.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS source
FROM o LEFT JOIN i USING (folder)"""


@query(_sql())
def op10_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_paths(table(spark, sf_dir, "documents"))
    return licence_scan(files, template_table(spark), key="doc_id")
