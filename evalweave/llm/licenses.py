"""License scan (operator 3), in DataFrame functions alone.

A text is cut into statements: lines, sentences within them, and sentences that
go on over several lines (up to an empty line or one of comment marks alone),
joined.  A file named like a license file is a statement as a whole, too.  A
statement is a sparse TF-IDF vector over its words; document frequencies of the
templates' terms are counted over all texts, and words of no template count as if no
text had them.  Templates are the usual headers, for statements within files, and the
full texts of short licenses, for files as a whole.  A statement has the license of the template with the largest cosine of at least
``NEAR`` whose telling clauses agree; a file has that of its best statement.

Telling clauses tell apart licenses that share their wording: phrases that the
statement must have or must not have (such as "any later version"), and phrases
that the file must have or must not have (such as the third clause of BSD-3-Clause).

Only statements with an anchor term are looked at.  A template's anchors are its
heaviest terms, so many that the rest alone can't reach the cosine; so nothing
is lost by it.

A file named like a license file gives its license to its directory (best
cosine; ties: smaller path).  Files without a statement of their own inherit
from their nearest ancestor directory that has one, by joins of directories with
their ancestors.  Joins of files with directories are salted, as one directory
may hold a third of the files.

Null and empty texts have no statement; texts of any length are cut whole.  A null
path has no directory and inherits nothing.  Ties of statements go to the larger
cosine, then the smaller license name, then the earlier statement (a whole file comes
first).  Repeated rows stay; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

NEAR = 0.75
SALT = 16
FILE_NAME = "(?i)^(licen[cs]e|copying|unlicense|notice)([-.].*)?$"

# Statements by which licenses are declared, and full texts of short licenses.
_GPL = "This program is free software{}you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{}"
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
    "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_GRANT = (
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
)
_MIT_KEEP = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = (
    " The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_MORE = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_ZLIB_MORE = (
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
)
_LATER, _BINARY, _ENDORSE, _ADVERTISE, _APPEAR, _INCLUDED = "any later version", "redistributions in binary form must reproduce", "endorse or promote products derived from this software", "all advertising materials mentioning features", "this permission notice appear in all copies", "this permission notice shall be included"


@dataclass(frozen=True)
class Template:
    """A statement of a license; phrases (of words in lower case) that it, and its file, must have or must not have."""

    license: str
    text: str
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    file_has: tuple[str, ...] = ()
    file_lacks: tuple[str, ...] = ()
    #: A full text, compared with whole files; others are compared with statements.
    whole: bool = False


def _gnu() -> list[Template]:
    out = []
    for name, title, version, stop in (("GPL-2.0", "General Public License", "2", "; "), ("GPL-3.0", "General Public License", "3", ": "), ("AGPL-3.0", "Affero General Public License", "3", ": "), ("LGPL-3.0", "Lesser General Public License", "3", ": ")):
        own = title.split()[0].lower()
        told = (f"version {version}", *((own,) if own != "general" else ()))
        others = tuple(x for x in ("affero", "lesser", "library") if x != own)
        # a library that is free software may say so of itself
        others = tuple(x for x in others if own == "general" or x != "library")
        out += [
            Template(f"{name}-or-later", _GPL.format(stop, title, f", either version {version} of the License, or (at your option) any later version."), (*told, _LATER), others),
            Template(f"{name}-only", _GPL.format(stop, title, f", version {version} of the License."), told, (*others, _LATER)),
            Template(f"{name}-only", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {title} version {version} as published by the Free Software Foundation.", told, (*others, _LATER)),
        ]
    out += [Template(f"LGPL-{v}-or-later", _LIBRARY.format(v), ("lesser", f"version {v.replace('.', ' ')} of", _LATER)) for v in ("2.1", "3")]
    out += [Template(f"LGPL-{v}-only", _LIBRARY.format(v).replace("either version", "version").replace(", or (at your option) any later version", ""), ("lesser", f"version {v.replace('.', ' ')} of"), (_LATER,)) for v in ("2.1", "3")]
    out += [Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("version 3",), ("affero", "lesser", _LATER))]
    for name, title in (("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007")):
        own = {"LGPL": "lesser", "AGPL": "affero"}.get(name.split("-")[0])
        told = ("version " + name.split("-")[1].removesuffix(".0").replace(".", " "), *((own,) if own else ()))
        out.append(Template(name, title, told, tuple(x for x in ("affero", "lesser", "free software") if x != own)))
    return [Template(t.license.replace("LGPL-3-", "LGPL-3.0-"), t.text, t.has, t.lacks) for t in out]


TEMPLATES = [
    *_gnu(),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004"),
    Template("BSD-2-Clause", _BSD, (), (), (_BINARY,), (_ENDORSE, _ADVERTISE)),
    Template("BSD-2-Clause", " ".join([_BSD, _BSD_1, _BSD_2, _BSD_END]), (), (_ENDORSE, _ADVERTISE), whole=True),
    Template("BSD-3-Clause", _BSD, (), (), (_ENDORSE,), (_ADVERTISE,)),
    # without any of its clauses the statement is taken for the commonest license that has it
    Template("BSD-3-Clause", _BSD, (), (), (), (_BINARY, _ADVERTISE)),
    Template("BSD-3-Clause", " ".join([_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_END]), (_ENDORSE,), (_ADVERTISE,), whole=True),
    Template("BSD-4-Clause", _BSD, (), (), (_ADVERTISE,)),
    Template("BSL-1.0", _BOOST),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    Template("0BSD", _ISC, (), (), (), (_APPEAR,)),
    Template("0BSD", f"{_ISC}. {_ISC_END}", (), (_APPEAR,), whole=True),
    Template("ISC", _ISC + _ISC_KEEP, (), (), (_APPEAR,)),
    Template("ISC", f"{_ISC}{_ISC_KEEP} {_ISC_END}", (_APPEAR,), whole=True),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", _MIT),
    Template("MIT", _MIT + _MIT_GRANT, (), (), (_INCLUDED,)),
    Template("MIT", _MIT + _MIT_GRANT + _MIT_KEEP + _MIT_END, (_INCLUDED,), whole=True),
    Template("MIT-0", _MIT + _MIT_GRANT, (), (), (), (_INCLUDED,)),
    Template("MIT-0", _MIT + _MIT_GRANT + "." + _MIT_END, (), (_INCLUDED,), whole=True),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "Mozilla Public License Version 2.0"),
    Template("Proprietary", "All rights reserved."),
    Template("Unlicense", _UNLICENSE),
    Template("Unlicense", _UNLICENSE + _UNLICENSE_MORE, whole=True),
    Template("Zlib", _ZLIB),
    Template("Zlib", _ZLIB + _ZLIB_MORE, ("must not be misrepresented",), whole=True),
]


def phrases(templates: list[Template]) -> list[str]:
    return sorted({p for t in templates for p in (*t.has, *t.lacks, *t.file_has, *t.file_lacks)})


#: Empty lines, and lines of comment marks alone.
EMPTY_LINES = r"\n[ \t\r\n#*;/]*\n"
SENTENCE_ENDS = r"([.!?])[ \t\r\n]+"


def cut(text: Column) -> Column:
    """Lines and sentences of a text, then its sentences of several lines."""
    sentences = F.split(F.regexp_replace(F.regexp_replace(text, EMPTY_LINES, "\x01"), SENTENCE_ENDS, "$1\x01"), "\x01")
    several = F.filter(sentences, lambda x: x.contains("\n"))
    return F.concat(F.flatten(F.transform(sentences, lambda x: F.split(x, "\n"))), several)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_terms(templates: list[Template]) -> list[dict[str, int]]:
    """Term counts of each template."""
    out = []
    for t in templates:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in t.text.lower()).split()
        out.append({w: words.count(w) for w in words})
    return out


def said(words: Column, known: list[str]) -> Column:
    """Which of the phrases some words have, by number."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return let(text, lambda x: F.filter(F.array(*(F.when(x.contains(f" {p} "), F.lit(i)) for i, p in enumerate(known))), lambda i: i.isNotNull()))


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those with each term of the templates (a row for each such term comes to the driver)."""
    found = files.select(F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = found.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def anchors(vectors: list[dict[str, float]], near: float, common: dict[str, int] | None = None) -> list[str]:
    """Terms of which a text near any of the vectors has one: of each vector the rarest (then heaviest), until the rest can't reach the cosine."""
    out = set()
    for v in vectors:
        left = total = sum(x * x for x in v.values())
        for term, x in sorted(v.items(), key=lambda t: ((common or {}).get(t[0], 0), -t[1], t[0])):
            if left < near * near * total * (1 - 1e-9):
                break
            out.add(term)
            left -= x * x
    return sorted(out)


#: Shorter anchors are looked for as words, as many longer words have them within.
SHORT = 5


def any_of(low: Column, words: list[str]) -> Column:
    """Whether a text in lower case may have one of some words."""
    found = functools.reduce(lambda a, w: a | low.contains(w), [w for w in words if len(w) >= SHORT], F.lit(False))
    short = "|".join(w for w in words if len(w) < SHORT)
    return found | low.rlike(f"(?<![a-z0-9])(?:{short})(?![a-z0-9])") if short else found


def statements(files: DataFrame, templates: list[Template] = TEMPLATES, near: float = NEAR) -> DataFrame:
    """key, license, cosine: the best statement of each file (key, text, and whole: whether the file is a statement, too) that has one."""
    spark = files.sparkSession
    counted = template_terms(templates)
    vocabulary = sorted(set().union(*counted))
    n, df = document_frequencies(files.where("text is not null"), vocabulary)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + n) + 1
    vectors = [{w: c * idf[w] for w, c in counts.items()} for counts in counted]
    first, first_whole = (anchors([v for v, t in zip(vectors, templates) if t.whole == whole], near, df) for whole in (False, True))
    known = phrases(templates)
    number = {p: i for i, p in enumerate(known)}
    weights = spark.createDataFrame([(w, idf[w], i, v.get(w, 0.0) * idf[w]) for i, v in enumerate(vectors) for w in v], "w string, idf double, template int, product double")
    told = [(i, t.license, t.whole, math.sqrt(sum(x * x for x in v.values())), *([number[p] for p in x] for x in (t.has, t.lacks, t.file_has, t.file_lacks))) for i, (t, v) in enumerate(zip(templates, vectors))]
    lengths = spark.createDataFrame(told, "template int, license string, whole boolean, template_length double, has array<int>, lacks array<int>, file_has array<int>, file_lacks array<int>")
    low = F.lower("text")
    all_units = F.concat(F.transform(cut(F.col("text")), lambda x, i: F.struct(i.alias("unit"), x.alias("statement"))), F.when(F.col("whole"), F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("statement")))).otherwise(F.array().cast("array<struct<unit:int,statement:string>>")))
    units = files.where(any_of(low, first) | (F.col("whole") & any_of(low, first_whole))).select("key", F.explode(all_units).alias("u")).select("key", "u.unit", terms(F.col("u.statement")).alias("words"))
    anchored = lambda words: F.arrays_overlap("words", F.array(*map(F.lit, words)))
    units = units.where(F.when(F.col("unit") < 0, anchored(first_whole)).otherwise(anchored(first))).withColumn("said", said(F.col("words"), known))
    units = written(units, "statements")
    counts = units.select("key", "unit", F.explode("words").alias("w")).groupBy("key", "unit", "w").agg(F.count("*").alias("tf"))
    counts = written(counts, "statement-terms")
    weight = spark.createDataFrame([(w, x) for w, x in idf.items()], "w string, idf double")
    # the tables of terms and templates are as small as the list of templates
    norms = counts.join(F.broadcast(weight), "w", "left").groupBy("key", "unit").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(unseen)), F.lit(2)))).alias("length"))
    dots = counts.join(F.broadcast(weights), "w").groupBy("key", "unit", "template").agg(F.sum(F.col("tf") * F.col("product")).alias("dot"))
    scored = dots.join(F.broadcast(lengths), "template").where((F.col("unit") < 0) == F.col("whole")).join(norms, ["key", "unit"])
    scored = scored.withColumn("cosine", F.round(F.col("dot") / (F.col("length") * F.col("template_length")), 6)).where(F.col("cosine") >= near)
    # telling clauses: of the statement, and of the file, which only files with a near statement are read for
    scored = scored.join(units.select("key", "unit", "said"), ["key", "unit"]).where((F.size(F.array_except("has", "said")) == 0) & ~F.arrays_overlap("lacks", "said"))
    scored = written(scored.select("key", "unit", "license", "cosine", "file_has", "file_lacks"), "near-statements")
    texts = files.join(scored.select("key").distinct(), "key", "left_semi").select("key", said(terms(F.col("text")), known).alias("file_said"))
    scored = scored.join(texts, "key").where((F.size(F.array_except("file_has", "file_said")) == 0) & ~F.arrays_overlap("file_lacks", "file_said"))
    return scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license", "unit")).alias("best")).select("key", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))


def folder(path: Column) -> Column:
    """Everything before the last slash; the root is the empty text."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def named_license(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(FILE_NAME)


def inherited(files: DataFrame) -> DataFrame:
    """``files`` (key, path, license, cosine) with license, origin, source_dir and levels.

    origin: file (own, of a license file), header (own), inherited, or null.
    """
    files = files.withColumn("dir", folder(F.col("path"))).withColumn("is_file", named_license(F.col("path")))
    given = files.where("is_file and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "path", "license")).alias("best"))
    given = given.select(F.col("dir").alias("ancestor"), F.col("best.license").alias("dir_license"))
    dirs = files.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.withColumn("depth", depth).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    above = above.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/"))
    nearest = above.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("level", "depth", "ancestor", "dir_license")).alias("up"))
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = files.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALT)).cast("int")).join(salted, ["dir", "salt"], "left")
    own = F.col("license").isNotNull()
    return joined.select(
        "key",
        "path",
        F.coalesce("license", "up.dir_license").alias("license"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("up").isNotNull(), "inherited").alias("origin"),
        "cosine",
        F.when(~own, F.col("up.ancestor")).alias("source_dir"),
        F.when(~own, F.col("up.depth") - F.col("up.level")).cast("long").alias("levels"),
    )


def scan(files: DataFrame, templates: list[Template] = TEMPLATES, near: float = NEAR) -> DataFrame:
    """License of each file (key: unique, path, text), its own or inherited."""
    found = statements(files.select("key", "text", F.coalesce(named_license(F.col("path")), F.lit(False)).alias("whole")), templates, near)
    return inherited(files.select("key", "path").join(found, "key", "left"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, source/lang or source/lang/digit, every fifth named like a license file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    digit = (F.floor(F.col("doc_id") / 3) % 10).cast("string")
    deep = F.col("doc_id") % 3
    path = F.when(deep == 0, F.concat_ws("/", "source", name)).when(deep == 1, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", digit, name))
    files = docs.select(F.col("doc_id").alias("key"), path.alias("path"), F.col("text").cast("string").alias("text"))
    return scan(files).withColumnRenamed("key", "doc_id")


def _sql_list(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"' {t} '" for t in texts) + "]::varchar[]"


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}', {}, {}, {}, {}, {})".format(i, t.license, t.text.replace("'", "''"), t.whole, *map(_sql_list, (t.has, t.lacks, t.file_has, t.file_lacks))) for i, t in enumerate(TEMPLATES))
ORACLE_OP3 = f"""
with files as (
  select doc_id as key, text, source || case doc_id % 3 when 0 then '/' when 1 then '/' || lang || '/' else '/' || lang || '/' || ((doc_id // 3) % 10)::varchar || '/' end
    || case when doc_id % 5 = 0 then 'LICENSE-' || doc_id::varchar else doc_id::varchar || '.txt' end as path
  from documents
), templates(template, license, text, whole, has, lacks, file_has, file_lacks) as (values {_TEMPLATE_ROWS}),
tt as (select template, license, w, count(*) as tf from (select template, license, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as w from templates) where w <> '' group by all),
vocabulary as (select distinct w from tt),
total as (select count(*) as n from files where text is not null),
df as (select w, count(*) as df from (select key, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) as w from files where text is not null) semi join vocabulary using (w) group by w),
idf as (select v.w, ln((1 + n)::double / (1 + coalesce(df, 0))) + 1 as idf from vocabulary v left join df using (w), total),
tw as (select template, license, w, tf * idf as x, idf from tt join idf using (w)),
tl as (select template, sqrt(sum(x * x)) as tlen from tw group by template),
sentences as (select key, string_split(regexp_replace(regexp_replace(text, '\\n[ \\t\\r\\n#*;/]*\\n', chr(1), 'g'), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) as s from files),
units as (select key, unnest(u) as statement, generate_subscripts(u, 1) - 1 as unit from (select key, list_concat(flatten(list_transform(s, lambda x: string_split(x, chr(10)))), list_filter(s, lambda x: contains(x, chr(10)))) as u from sentences)
  union all select key, text, -1 from files where regexp_matches(string_split(path, '/')[-1], '(?i)^(licen[cs]e|copying|unlicense|notice)([-.].*)?$')),
counts as (select key, unit, w, count(*) as tf from (select key, unit, unnest(string_split_regex(lower(statement), '[^a-z0-9]+')) as w from units) where w <> '' group by all),
norms as (select key, unit, sqrt(sum((tf * coalesce(idf, ln(1 + n) + 1)) ** 2)) as len from counts left join idf using (w), total group by all),
dots as (select key, unit, template, license, sum(tf * idf * x) as dot from counts join tw using (w) group by all),
near as (select key, unit, license, template, round(dot / (len * tlen), 6) as cosine from dots join tl using (template) join norms using (key, unit) where round(dot / (len * tlen), 6) >= {NEAR}),
plain as (select n.*, ' ' || trim(regexp_replace(lower(statement), '[^a-z0-9]+', ' ', 'g')) || ' ' as said, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as file_said from near n join units using (key, unit) join files using (key)),
scored as (select key, unit, p.license, cosine from plain p join templates t using (template) where (unit < 0) = whole and len(list_filter(has, lambda x: not contains(said, x))) = 0 and len(list_filter(lacks, lambda x: contains(said, x))) = 0
  and len(list_filter(file_has, lambda x: not contains(file_said, x))) = 0 and len(list_filter(file_lacks, lambda x: contains(file_said, x))) = 0),
best as (select key, license, cosine from (select *, row_number() over (partition by key order by cosine desc, license, unit) as r from scored) where r = 1),
owned as (select f.key, f.path, b.license, b.cosine, regexp_replace(f.path, '/[^/]*$', '') as dir, regexp_matches(string_split(f.path, '/')[-1], '(?i)^(licen[cs]e|copying|unlicense|notice)([-.].*)?$') as is_file from files f left join best b using (key)),
given as (select dir as ancestor, license as dir_license from (select *, row_number() over (partition by dir order by cosine desc, path) as r from owned where is_file and license is not null) where r = 1),
above as (select dir, depth, level, array_to_string(string_split(dir, '/')[1:level], '/') as ancestor from (select dir, len(string_split(dir, '/')) as depth, unnest(range(0, len(string_split(dir, '/')) + 1)) as level from (select distinct dir from owned))),
up as (select * from (select *, row_number() over (partition by dir order by level desc) as r from above join given using (ancestor)) where r = 1)
select o.key as doc_id, o.path, coalesce(o.license, up.dir_license) as license,
  case when o.license is not null and is_file then 'file' when o.license is not null then 'header' when up.dir is not null then 'inherited' end as origin,
  o.cosine, case when o.license is null then up.ancestor end as source_dir, case when o.license is null then (up.depth - up.level)::bigint end as levels
from owned o left join up using (dir)
"""
