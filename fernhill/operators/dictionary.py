"""Phrases of a dictionary of any size in texts: word windows meet phrases in an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernhill.functions.text import norm_alnum


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_col: str, words: Column, phrase: str = "phrase") -> DataFrame:
    """``texts`` joined with the phrases that they hold as whole words, and ``at``, the number of the first word.

    ``words`` gives a text's word array; a phrase is words with one space between. Windows are made for
    the phrase lengths that occur (a few numbers, which the driver reads), so that a text of n words has n
    windows for each, and only equal strings meet, whatever the number of phrases. Texts are dealt by id
    first, since a small file of long texts is one task otherwise; their words are made once, and windows
    meet the phrases before they are grouped, so that only hits are. An empty phrase is nowhere, equal
    rows of phrases count once; null texts hold nothing.
    """
    known = phrases.where(F.length(phrase) > 0)
    lengths = [r[0] for r in known.select(F.size(_words(F.col(phrase)))).distinct().collect()]
    held = F.col("\0words")

    def made(n: int) -> Column:
        if n == 1:
            return F.transform(held, lambda x, i: F.struct(i.alias("at"), x.alias("window")))
        starts = F.when(F.size(held) >= n, F.sequence(F.lit(0), F.size(held) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(held, i + 1, n), " ").alias("window")))

    split = texts.repartition(id_col).select(id_col, F.coalesce(words, F.array().cast("array<string>")).alias("\0words"))
    windows = split.select(id_col, F.explode(F.concat(*map(made, sorted(lengths)))).alias("w")) if lengths else split.select(id_col, F.lit(None).cast("struct<at:int,window:string>").alias("w")).limit(0)
    met = windows.select(id_col, F.col("w.window").alias("\0window"), F.col("w.at").alias("at")).join(known, F.col("\0window") == F.col(phrase))
    # a text's windows of one string count once
    return met.groupBy(id_col, *known.columns).agg(F.min("at").alias("at"))


def phrase_match(texts: DataFrame, phrases: DataFrame, id_col: str) -> DataFrame:
    """(id, phrase, result): the longest phrase that a text holds as words, the leftmost among equals."""
    hits = phrase_hits(texts, phrases, id_col, _words(norm_alnum(F.col("text"))))
    w = W.partitionBy(id_col).orderBy(F.desc(F.length("phrase")), "at", "phrase")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select(id_col, "phrase", "result")


def annotate_queries(texts: DataFrame, brands: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, brand, residual): the longest brand that a text names as words, ties by name, and the text without it.

    texts: (id, text); brands: (brand). Letters are compared without case; every place of the brand goes.
    """
    known = brands.select("brand", F.lower("brand").alias("phrase")).distinct()
    hits = phrase_hits(texts, known, id_col, _words(F.lower("text"))).join(texts, id_col)
    w = W.partitionBy(id_col).orderBy(F.desc(F.length("brand")), "brand")
    named = F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    residual = F.trim(F.replace(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), named, F.lit(" ")))
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select(id_col, "brand", residual.alias("residual"))
