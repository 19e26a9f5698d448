"""A corpus-cleaning pipeline over ``documents``: each stage's table is written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fernhill.llm import decontamination, line_dedup, near_duplicates, packing, toxicity
from fernhill.llm._shared import documents, fresh, shared_dir


def _without(docs, gone):
    """The documents but those with an id and text in ``gone`` (doc_id, text_key)."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    gone = gone.toDF("id", "code")
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["id"]) & (keyed[key] == gone["code"]), "left_anti").select(*docs.columns)


def reject_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score under 0.5; the model learns from the labels of these documents.

    Null and empty texts get the intercept's score; repeated rows and other columns stay as they are.
    """
    weights = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.score_toxicity(docs, weights, out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark, docs, sf_dir):
    """All documents, without lines that three or more of them hold but in the last; n_chars follows.

    Null text becomes empty; ids that repeat hold a line once, a null id is the smallest.
    """
    kept = line_dedup.drop_repeated_lines(docs, counts=(fresh(docs, "lines"), fresh(docs, "dropped")))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group linked by Jaccard of 0.8 on five words.

    All rows of that id in the group stay, so that an exact repeat of a kept row does; documents without
    words (null or empty text) are linked with nothing and stay.
    """
    groups = near_duplicates.near_duplicates(docs).where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    return _without(docs, groups)


def drop_leaks(spark, docs, sf_dir):
    """Documents in which no benchmark item was found; null and empty texts hold none, repeated rows go or stay together."""
    leaks = decontamination.find_leaks(docs, documents(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    return _without(docs, leaks)


def pack(spark, docs, sf_dir):
    """Sequences of at most 2048 ids: a row per piece, with its ids. Null text is a document of the end id alone; repeated rows are packed as often as they come."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), from_files=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The models and the joins by hash have no SQL; tests/llm/test_brute.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
