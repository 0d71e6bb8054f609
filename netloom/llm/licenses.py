"""License scans: sparse TF-IDF cosine of licence statements to templates, then inheritance by directory.

Everything is DataFrame functions. The document frequency of every word is counted over all texts. A text's lines are its possible headers; a line, the whole text, or as many consecutive words as
a template has (wherever they begin, over line ends) is compared with every template. Templates are usual statements and, in
``licence_texts``, whole short licences, standard headers and the openings of long ones. A tag ``SPDX-License-Identifier`` names
the licence itself. A line without any of the cue words can't reach the threshold (``cue_words`` shows why),
so only lines with one are weighed. Files without a licence of their own take that of their nearest
ancestor directory that has a licence file.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from .licence_texts import PASSAGES, SHARED

# Usual statements of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This program is free software licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Fewer words are a mere name, which counts as a line of its own only.
LEAST_WINDOW = 5
SPDX_ID = "[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX_TAG = rf"(?i:SPDX-License-Identifier):[ \t]*([( ]*{SPDX_ID}[) ]*(?:(?:OR|AND|WITH) [( ]*{SPDX_ID}[) ]*)*)"
LICENCE_FILES = ("license", "licence", "copying", "unlicense")
#: Bytes that stand between tokens, beside the space; a dot before a space is dropped as well.
BREAKS = "\t\n\x0b\f\r!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~"


def tokens_of(text: str) -> list[str]:
    """As ``tokens`` does on columns, for templates."""
    spaced = " " + text.lower().translate(str.maketrans(BREAKS, " " * len(BREAKS))) + " "
    return [w for w in spaced.replace(". ", " ").split(" ") if w]


def tokens(text: Column) -> Column:
    """Words in lower case; a dot before a break is dropped, one within a word stays."""
    breaks = "".join("\\" + c if c.isprintable() else c for c in BREAKS)
    return F.filter(F.split(F.concat(F.lower(text), F.lit(" ")), rf"\.?[ {breaks}]+"), lambda w: w != "")


def has_any(words: Column, cues: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in cues]))


def template_weights(texts: list[str], df: dict[str, int], n_docs: int) -> dict[int, dict[str, float]]:
    """Each template's unit vector."""
    unit = {}
    for k, text in enumerate(texts):
        raw = {w: c * (math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1) for w, c in Counter(tokens_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        unit[k] = {w: x / norm for w, x in raw.items()}
    return unit


def cue_words(unit: dict[int, dict[str, float]], df: dict[str, int], threshold: float) -> list[str]:
    """Words of every template, heavy and in few texts first, until the rest of its vector is shorter than the threshold.

    A cosine is at most the length of the template's part that both share, so a line with none of these words
    stays below the threshold."""
    cues = set()
    for vector in unit.values():
        rest = 1.0
        for word, x in sorted(vector.items(), key=lambda p: (-p[1] * p[1] / (df.get(p[0], 0) + 1), p[0])):
            if math.sqrt(max(rest, 0.0)) < threshold * 0.999:
                break
            cues.add(word)
            rest -= x * x
    return sorted(cues)


def with_idf(terms: DataFrame, counted: DataFrame, n_docs: int) -> DataFrame:
    """Add ``idf`` of ``token``; only the words at hand are joined, so that they stay small beside the vocabulary."""
    known = counted.join(terms.select("token").distinct(), "token", "left_semi")
    return terms.join(known, "token", "left").withColumn("idf", F.log((F.lit(n_docs) + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1).drop("df")


def cosines(units: DataFrame, counted: DataFrame, n_docs: int, vectors: DataFrame, threshold: float) -> DataFrame:
    """``(unit_key, best struct(rank, score, license), n_words)`` of distinct ``(unit_key, words)`` rows that reach the threshold.

    The template table has a row for each template and word: its size is the given templates', not the data's. Units without
    words and an empty table give nothing; equal units must be one row."""
    terms = units.select("unit_key", F.explode("words").alias("token")).groupBy("unit_key", "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = with_idf(terms, counted, n_docs).withColumn("x", F.col("tf") * F.col("idf"))
    norms = terms.groupBy("unit_key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("n_words"))
    dots = terms.join(F.broadcast(vectors), "token").groupBy("unit_key", "template", "rank", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "unit_key").select("unit_key", "n_words", F.struct("rank", F.round(F.col("dot") / F.col("norm"), 9).alias("score"), "license").alias("best"))
    return scored.filter(F.col("best.score") >= threshold).groupBy("unit_key").agg(F.max("best").alias("best"), F.max("n_words").alias("n_words"))


def windows(texts: DataFrame, counted: DataFrame, n_docs: int, vectors: DataFrame, cues: dict[int, list[str]], sizes: dict[int, int], threshold: float) -> DataFrame:
    """``(row_key, total, words, unit_key)``: runs of as many words as a template has that may reach the threshold.

    Such a run has one of the template's cue words, so runs around those are enough. The sum of squared IDF over a
    run's words is at most its squared norm, so it gives an upper bound of the cosine that slides; runs below the threshold by it go."""
    spark = texts.sparkSession
    table = spark.createDataFrame([(w, k, sizes[k]) for k, words in cues.items() for w in words], "token string, template int, size int")
    every = sorted({w for words in cues.values() for w in words})
    marked = F.transform("words", lambda w, i: F.when(w.isin(every), F.struct(w.alias("token"), i.alias("at"))))
    hits = texts.select("row_key", "total", "words", F.explode(F.filter(marked, lambda x: x.isNotNull())).alias("hit"))
    hits = hits.withColumn("token", F.col("hit.token")).join(F.broadcast(table), "token").filter("total >= size")
    begin = F.greatest(F.col("hit.at") - F.col("size") + 1, F.lit(0))
    hits = hits.select("row_key", "total", "template", "size", F.slice("words", begin + 1, F.col("hit.at") + F.col("size") - begin).alias("part"))
    hits = materialize(hits.withColumn("part_key", F.md5(F.concat_ws(" ", F.col("template").cast("string"), F.col("part")))), "licences-parts")
    # equal surroundings are weighed once, however many texts have them
    parts = hits.groupBy("part_key").agg(F.first("template").alias("template"), F.first("size").alias("size"), F.first("part").alias("part"))
    placed = with_idf(parts.select("part_key", "template", "size", F.posexplode("part").alias("at", "token")), counted, n_docs)
    placed = placed.join(F.broadcast(vectors.select("template", "token", "weight")), ["template", "token"], "left")
    # places are in units of the size (2 ** 32 of it), so that one frame fits all templates
    run = Window.partitionBy("part_key").orderBy(F.expr("CAST(at AS BIGINT) * 4294967296 DIV size")).rangeBetween(0, 2**32 - 2**16)
    bound = placed.select("part_key", "at", "size", F.sum(F.col("idf") * F.coalesce("weight", F.lit(0.0))).over(run).alias("dot"), F.sum(F.col("idf") * F.col("idf")).over(run).alias("square"), F.count(F.lit(1)).over(run).alias("n"))
    likely = bound.filter((F.col("n") == F.col("size")) & (F.col("dot") >= F.lit(threshold * 0.999999) * F.sqrt("square"))).select("part_key", "at")
    found = likely.join(parts.select("part_key", "size", "part"), "part_key").select("part_key", F.slice("part", F.col("at") + 1, F.col("size")).alias("words"))
    runs = hits.select("row_key", "total", "part_key").join(found, "part_key")
    return runs.select("row_key", "total", "words", F.md5(F.array_join("words", " ")).alias("unit_key"))


def tagged(files: DataFrame) -> DataFrame:
    """``(row_key, tag)``: licences named by SPDX tags, of several the last name; what a WITH adds is left out.

    ``-only``, ``-or-later`` and ``+`` are dropped, as templates don't tell these apart."""
    said = files.filter(F.contains(F.lower("text"), F.lit("spdx-license-identifier"))).select("row_key", F.explode(F.regexp_extract_all("text", F.lit(SPDX_TAG), F.lit(1))).alias("said"))
    names = said.select("row_key", F.explode(F.split(F.regexp_replace("said", rf" WITH {SPDX_ID}", ""), "[() ]+")).alias("name")).filter("name NOT IN ('', 'OR', 'AND', 'NONE', 'NOASSERTION')")
    name = F.regexp_replace(F.regexp_replace("name", "[.-]+$", ""), r"(-only|-or-later|\+)$", "")
    return names.groupBy("row_key").agg(F.max(F.struct(F.lit(1).alias("rank"), F.lit(1.0).alias("score"), name.alias("license"))).alias("tag"))


def document_frequencies(files: DataFrame) -> DataFrame:
    """``(token, df)``: in how many texts each word stands, of all words over all texts."""
    words = files.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return materialize(words.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "licences-words")


def scan_texts(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, file_share: float = 0.2) -> DataFrame:
    """Put ``own`` (best licence of any line, run of words, tag or of the whole text, with its score) and ``is_licence_file`` for ``text``.

    A licence file is named like one, or has ``file_share`` or more of its words in licence lines or a licence's run; a tag
    speaks for its own file only. Equal lines and runs are weighed once, however many texts have them. ``text`` must not be null; an empty
    one has no licence. Repeated rows stay, ties go to the licence last by name.
    The passages of ``licence_texts`` are added to the templates; those shared by licences count where nothing else is found."""
    items = [(name, 1, text) for name, text in [*templates.items(), *PASSAGES]] + [(name, 0, text) for name, text in SHARED]
    vocabulary = sorted({w for _, _, text in items for w in tokens_of(text)})
    counted, n = document_frequencies(files), files.count()
    df = {r["token"]: r["df"] for r in counted.filter(F.col("token").isin(vocabulary)).collect()}
    unit = template_weights([text for _, _, text in items], df, n)
    cues_of = {k: cue_words({k: v}, df, threshold) for k, v in unit.items()}
    cues = sorted({w for words in cues_of.values() for w in words})
    sizes = {k: len(tokens_of(text)) for k, (_, _, text) in enumerate(items)}
    rows = [(w, k, items[k][0], items[k][1], float(x)) for k, v in unit.items() for w, x in v.items()]
    vectors = files.sparkSession.createDataFrame(rows, "token string, template int, license string, rank int, weight double")

    cued = has_any(tokens(F.col("text")), cues) | F.contains(F.lower("text"), F.lit("spdx-license-identifier"))
    files = materialize(files.select("file_id", "path", F.when(cued, F.col("text")).alias("text")), "licences-cued").withColumn("row_key", F.monotonically_increasing_id())
    texts = files.filter("text IS NOT NULL").select("row_key", "text", tokens(F.col("text")).alias("words")).withColumn("total", F.size("words"))
    # a text of several lines counts as one unit as well; statements may run over line ends
    several = F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = texts.select("row_key", "total", F.explode(F.concat(several, F.split("text", "\n"))).alias("unit"))
    units = units.withColumn("words", tokens(F.col("unit"))).filter(has_any(F.col("words"), cues))
    units = units.select("row_key", "total", "words", F.md5("unit").alias("unit_key"), F.when(F.contains("unit", F.lit("\n")), "whole").otherwise("line").alias("kind"))
    wide = {k: words for k, words in cues_of.items() if sizes[k] >= LEAST_WINDOW}
    runs = windows(texts.drop("text"), counted, n, vectors, wide, sizes, threshold).withColumn("kind", F.lit("run"))
    units = materialize(units.unionByName(runs), "licences-units")
    best = cosines(units.groupBy("unit_key").agg(F.first("words").alias("words")), counted, n, vectors, threshold)
    best = materialize(best, "licences-best")
    in_lines = F.greatest(F.sum(F.when(F.col("kind") == "line", F.col("n_words"))), F.max(F.when(F.col("kind") == "run", F.col("n_words"))), F.lit(0))
    own = units.join(best, "unit_key").groupBy("row_key").agg(F.max("best").alias("own"), F.max(F.col("kind") == "whole").alias("whole"), (in_lines / F.greatest(F.max("total"), F.lit(1))).alias("share"))
    own = own.join(tagged(files), "row_key", "full").select("row_key", F.greatest("own", "tag").alias("own"), F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("share", F.lit(0.0)).alias("share"))
    named = F.exists(F.array(*[F.lit(x) for x in LICENCE_FILES]), lambda x: F.split_part(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit("."), F.lit(1)) == x)
    is_file = F.col("own").isNotNull() & (F.coalesce(named, F.lit(False)) | F.col("whole") | (F.col("share") >= file_share))
    return files.drop("text").join(own, "row_key", "left").withColumn("is_licence_file", F.coalesce(is_file, F.lit(False))).select("file_id", "path", "own", "is_licence_file")


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, file_share: float = 0.2) -> DataFrame:
    """``file_id``, ``path``, ``license``, ``origin`` (own, inherited or none), ``licensed_by`` (the
    directory that gave it) and ``score``, one row for each row ``(file_id, path, text)``.

    Null and empty texts have no licence of their own. A null path has no directory: nothing is inherited.
    Of several licence files in one directory the best score counts, then the last licence name. Ties of templates
    go to the last name as well. Repeated rows stay. An empty table gives an empty table. Other columns aren't read.
    """
    base = files.select(F.col("file_id"), F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = scan_texts(base, templates, threshold, file_share)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    scanned = materialize(scanned.withColumn("folder", folder), "licences-scanned")
    given = scanned.filter("is_licence_file AND folder IS NOT NULL").groupBy("folder").agg(F.max("own").alias("given")).withColumnRenamed("folder", "ancestor")

    steps = F.split("folder", "/")
    need = scanned.filter("own IS NULL AND folder IS NOT NULL").select("folder").distinct()
    climbed = need.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).withColumn("ancestor", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = climbed.join(given, "ancestor").groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "given")).alias("from"))

    own = scanned.filter("own IS NOT NULL").select("file_id", "path", F.col("own.license").alias("license"), F.lit("own").alias("origin"), F.lit(None).cast("string").alias("licensed_by"), F.col("own.score").alias("score"))
    other = scanned.filter("own IS NULL").join(nearest, "folder", "left")
    other = other.select("file_id", "path", F.col("from.given.license").alias("license"), F.when(F.col("from").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"), F.col("from.ancestor").alias("licensed_by"), F.col("from.given.score").alias("score"))
    return own.unionByName(other)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents laid out as a tree: source / language / thousand of the id / id.

    A null source or language is ``unknown``; a null id leaves its parts of the path out. Repeated rows stay; other columns are left out."""
    doc_id = F.col("doc_id").cast("bigint")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(doc_id / 1000).cast("string"), F.concat(doc_id.cast("string"), F.lit(".txt")))
    return docs.select(doc_id.alias("file_id"), path.alias("path"), "text")
