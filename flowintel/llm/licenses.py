"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

The templates are one-sentence notices, standard headers and full licence texts.  Of a licence
file, and of any other file with a licence cue, these parts are compared with them by TF-IDF
cosine: the whole text, each sentence with a cue, and each tile of words with a cue, the tiles
overlapping at sizes from a notice to a full text.  idf counts those files; a term of no template
weighs 1.  A part much shorter than a template is not compared with it.  A file whose best part reaches MIN_SCORE has the licence of that template.  A licence file passes it on to
its directory; a file without a licence of its own takes that of the nearest directory above
it that has one.  Inheritance is resolved once per directory, by joining the directory's
ancestors with the directories that hold a licence file, and then reaches the files.

Null text counts as empty.  A null path stands alone: it neither passes on nor inherits.  Of
several licence files in a directory the one with the best score counts, then the smaller
path.  Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.session import checkpointed, join_per_key

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and distribute this software is granted under the ISC License",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense",
}
# Standard headers and full texts: <license>.<header or full>.txt
LONG_TEXTS = [(p.name.rsplit(".", 2)[0], p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
CUE = r"(?i)licen[sc]e|copyright|redistribution and use|public domain|creative commons"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SENTENCE_END = r"[.!?;:]+[ \t\r]+|\n"
TILES = ((12, 4), (40, 20), (160, 80), (640, 320))
MIN_SCORE = 0.5
# A part of fewer words than half a template, or than half the largest tile, shares little but common words with it.
MOST_LEAST_WORDS = TILES[-1][0] // 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def tiles(words: Column, size: int, step: int) -> Column:
    """Overlapping runs of `size` words that hold a cue."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)) + step - 1, F.lit(step))
    return F.filter(F.transform(starts, lambda i: F.slice(words, i + 1, size)), lambda x: F.array_join(x, " ").rlike(CUE))


def part_terms(files: DataFrame, key: str, text_col: str, whole: Column) -> DataFrame:
    """(key, part, term, tf) of the parts of every file with a cue or `whole`; part 0 is the whole text."""
    text = F.col(text_col).cast("string")
    held = files.where(text.rlike(CUE) | whole).select(
        key, F.filter(F.split(text, SENTENCE_END), lambda x: x.rlike(CUE)).alias("_sentences"), words_of(text).alias("_words"))
    parts = F.array_distinct(F.concat(
        F.array("_words"), F.transform("_sentences", words_of), *(tiles(F.col("_words"), *t) for t in TILES)))
    rows = held.select(key, F.posexplode(parts).alias("part", "_part")).select(key, "part", F.explode("_part").alias("term"))
    return rows.groupBy(key, "part", "term").agg(F.count("*").alias("tf"))


def damped(tf: str) -> Column:
    """1 + ln tf: texts are not alike by repeating common words."""
    return F.log(F.col(tf)) + 1


def best_templates(terms: DataFrame, key: str, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, license, score): the template most similar to a part of each file, if it reaches MIN_SCORE."""
    spark = terms.sparkSession
    texts = [*templates.items(), *LONG_TEXTS]
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "_t int, text string")
    template = rows.select("_t", F.explode(words_of(F.col("text"))).alias("term")).groupBy("_t", "term").agg(F.count("*").alias("_tf"))
    whole = terms.where("part = 0")
    counts = whole.join(F.broadcast(template.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("_df"))
    files = whole.agg(F.count_distinct(key).alias("_files"))
    idf = F.log((F.col("_files") + 1) / (F.coalesce("_df", F.lit(0)) + 1)) + 1
    weights = template.join(counts, "term", "left").crossJoin(F.broadcast(files)).select("_t", "term", "_tf", idf.alias("_idf"))
    weights = weights.withColumn("_w", damped("_tf") * F.col("_idf"))
    weights = weights.withColumn("_w", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_t"))))
    # one row per term, one column per template: a sum per template instead of a row per term and template
    wide = checkpointed(weights.groupBy("term").agg(
        F.max("_idf").alias("_idf"), *(F.sum(F.when(F.col("_t") == i, F.col("_w")).otherwise(0.0)).alias(f"_w{i}") for i in range(len(texts)))))
    weighed = terms.join(F.broadcast(wide), "term", "left").withColumn("_v", damped("tf") * F.coalesce("_idf", F.lit(1.0)))
    sums = weighed.groupBy(key, "part").agg(
        F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_length"), F.sum("tf").alias("_n"),
        *(F.sum(F.col("_v") * F.coalesce(f"_w{i}", F.lit(0.0))).alias(f"_d{i}") for i in range(len(texts))))
    least = [min(len(re.findall(TERM, text.lower())) // 2, MOST_LEAST_WORDS) for _, text in texts]
    scored = F.greatest(*(
        F.struct(F.when(F.col("_n") >= least[i], F.round(F.col(f"_d{i}") / F.col("_length"), 9)).otherwise(0.0).alias("score"),
                 F.lit(name).alias("license")) for i, (name, _) in enumerate(texts)))
    best = sums.groupBy(key).agg(F.max(scored).alias("_best"))
    return best.select(key, F.col("_best.license").alias("license"), F.col("_best.score").alias("score")).where(F.col("score") >= MIN_SCORE)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the root '' last."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def scan_licenses(files: DataFrame, is_license_file: Column, id_col: str = "doc_id", path_col: str = "path",
                  text_col: str = "text") -> DataFrame:
    """id, path, own_license, own_score, license, inherited_from (directory; null if own or none)."""
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"),
                        is_license_file.alias("_file"))
    # a file is known by path and text: repeated rows share their parts
    keyed = rows.withColumn("_key", F.xxhash64("path", "text"))
    terms = checkpointed(
        part_terms(keyed.where(F.col("text").rlike(CUE) | F.col("_file")).dropDuplicates(["_key"]), "_key", "text", F.col("_file")))
    own = checkpointed(best_templates(terms, "_key")).withColumnsRenamed({"license": "own_license", "score": "own_score"})
    slim = checkpointed(join_per_key(keyed.select("doc_id", "path", "_file", "_key"), own, "_key")
                        .withColumn("_folder", directory(F.col("path"))))
    holders = slim.where("_file and own_license is not null and path is not null").groupBy("_folder").agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("_held"))
    holders = holders.select(F.col("_folder").alias("_holder"), F.col("_held.own_license").alias("_passed"))
    folders = slim.where("path is not null").select("_folder").distinct()
    above = folders.select("_folder", F.posexplode(ancestors(F.col("_folder"))).alias("_steps", "_holder"))
    nearest = join_per_key(above, holders, "_holder", "inner").groupBy("_folder").agg(
        F.min(F.struct("_steps", "_holder", "_passed")).alias("_near"))
    nearest = nearest.select(F.col("_folder").alias("_below"), "_near")
    known = join_per_key(slim, nearest, (F.col("_folder") == F.col("_below")) & F.col("path").isNotNull())
    return known.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "_near._passed").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("_near._holder")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/thousand/id, every hundredth id being the directory's licence file."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                         F.floor(F.col("doc_id") / 1000).cast("string"))
    name = F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string")))
    return docs.withColumn("path", F.concat(folder, F.lit("/"), F.coalesce(name, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))
