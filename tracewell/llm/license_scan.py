"""License scans by diagonal voting.

Every pair of neighbouring words of every text is hashed and joined with the places of the same pairs in license
templates. Matches are counted by offset diagonal (place in the text less place in the template), and each diagonal is merged
with those up to DRIFT beyond it. A merged span is verified: its stretch of the text, in which words are known from the pairs that
match and all others are strangers, is aligned with the template, and edits of words count against it. A span of the text
that has a template's words in another order, or far apart, fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that make the base labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further short phrases and wordings of common licenses, in lower case without marks.
TEMPLATES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
]
#: A span needs this share of its template's words in place; diagonals up to DRIFT apart are one span.
SHARE, DRIFT = 0.8, 2
#: A letter for each distinct word of a template, which may have so many; a stranger in the text is none of them.
LETTERS, STRANGER = UPPER + LOWER, "#"


def text_words(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(t, BETWEEN), lambda w: w != "")


def template_rows(templates: list[tuple[str, str]] | None = None) -> list[tuple]:
    """(tid, label, base, length, spelt, tpos, a, b, letter of a, letter of b) for each place in each template."""
    given = templates if templates is not None else TEMPLATES
    rows = []
    for tid, (text, label, base) in enumerate([(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in given]):
        w = text.split()
        letter = dict(zip(dict.fromkeys(w), LETTERS, strict=False))
        if len(letter) < len(set(w)) or len(w) < 2:
            raise ValueError(f"a template has 2 words or more, {len(LETTERS)} different ones at most: {text}")
        spelt = "".join(letter[x] for x in w)
        rows += [(tid, label, base, len(w), spelt, k, w[k], w[k + 1], spelt[k], spelt[k + 1]) for k in range(len(w) - 1)]
    return rows


def template_pairs(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """template_rows() with the pairs' hash h. Its size doesn't depend on the data."""
    names = "tid, label, base, length, spelt, tpos, a, b, la, lb"
    values = ", ".join(f"({t}, '{x}', {base}, {n}, '{s}', {k}, '{a}', '{b}', '{la}', '{lb}')" for t, x, base, n, s, k, a, b, la, lb in template_rows(templates))
    return spark.sql(f"SELECT *, xxhash64(a, b) AS h FROM VALUES {values} AS t({names})")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, key, tid, label, base, first, last, right, length: a span for each diagonal with a match, verified or not.

    first and last are the words, from 0, at which the span's first and last pair begin; right is the template's length less the
    edits that make the span the template, 0 at least. Spans of base phrases have no drift.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("key"), text_words(F.col(text_col)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"))))
    each = rows.select("id", "key", F.posexplode(pairs).alias("pos", "p")).select("id", "key", "pos", "p.a", "p.b")
    places = template_pairs(docs.sparkSession, templates)
    # The hash finds, the words themselves verify. Templates are a fixed few hundred rows.
    hits = each.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(places), ["h", "a", "b"])
    group = ["id", "key", "tid", "label", "base", "length", "spelt"]
    votes = hits.groupBy(*group, (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_list(F.struct("pos", "la", "lb")).alias("at"))
    near = Window.partitionBy("id", "key", "tid").orderBy("diag")
    merged = votes.withColumn("at", F.when(F.col("base"), F.col("at")).otherwise(F.flatten(F.collect_list("at").over(near.rangeBetween(0, DRIFT)))))
    at = F.col("at")
    span = merged.withColumn("first", F.array_min(F.transform(at, lambda x: x["pos"]))).withColumn("last", F.array_max(F.transform(at, lambda x: x["pos"])))
    # A letter for each word of the span: a matching pair tells two.
    told = F.concat(F.transform(at, lambda x: F.struct(x["pos"].alias("p"), x["la"].alias("c"))), F.transform(at, lambda x: F.struct((x["pos"] + 1).alias("p"), x["lb"].alias("c"))))
    known = F.sort_array(F.array_distinct(told))
    spelt = F.aggregate(known, F.struct(F.lit("").alias("s"), F.col("first").alias("p")), lambda z, x: F.struct(F.concat(z["s"], F.repeat(F.lit(STRANGER), x["p"] - z["p"]), x["c"]).alias("s"), (x["p"] + 1).alias("p")), lambda z: z["s"])
    edits = F.levenshtein(spelt, F.col("spelt"))
    return span.select("id", "key", "tid", "label", "base", "first", "last", F.greatest(F.lit(0), F.col("length") - edits).alias("right"), "length")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base spans are places where a base phrase stands word for word; the other templates count from SHARE of
    their words in place on. score is the largest share of a template found, in whole hundredths. Null and empty texts have
    no words, labels "" and score 0; rows equal in id and text get equal results; columns beside the named ones are ignored.
    """
    found = spans(docs, id_col, text_col, templates)
    is_base = F.col("base") & (F.col("right") == F.col("length"))
    good = F.when(is_base | (~F.col("base") & (F.col("right") / F.col("length") >= SHARE)), F.col("label"))
    per = found.groupBy("id", "key").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(good)), ",").alias("labels"),
        (F.max(F.floor(100 * F.col("right") / F.col("length"))) / 100).alias("score"),
    )
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.size(text_words(F.col(text_col))).cast("long").alias("n_words"))
    r = per.withColumnsRenamed({"id": "_id", "key": "_key"})
    out = all_rows.join(r, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
