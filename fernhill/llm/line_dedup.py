"""Line dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernhill.llm._shared import WORD_SPACE, documents, materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without surrounding white space and with A-Z lowered (other letters stay)."""
    bare = F.btrim(line, F.lit(WORD_SPACE))
    # translate() works a character at a time; lower() does the same for ASCII lines and is far faster
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


#: Lines held by more than this share of all (line, document) pairs of common lines are salted; there are
#: at most 1 / HOT of them, so that their table can be broadcast.
HOT, SALTS = 1e-3, 64


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the largest id that holds them.

    Lines are exploded, keyed by 128 hash bits of ``line_key``, counted by distinct document, and
    documents are put together again by line position. A key held by a third of all rows is
    pre-aggregated before it moves; on the way back only (key, document, position) rows meet the
    common lines, and those of the hottest lines are dealt over ``SALTS`` tasks each.

    Returns the input columns with the new text, and the numbers of lines and of dropped lines under
    the names ``counts`` (input columns of these names are replaced). Null or empty text is one empty
    line and comes back empty. Rows that repeat an id count as one document and lose the same lines; a
    null id is a document of its own that is never the largest. An empty table gives an empty table.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    row = row.withColumn("code", F.xxhash64("body"))
    lines = (
        row.select("id", "code", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("id", "code", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    common = materialise(
        lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs), "common-lines",
    )
    total = common.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(HOT * total)
    lines = lines.join(F.broadcast(common.where(hot).select("h1", "h2", F.lit(1).alias("hot"))), ["h1", "h2"], "left")
    lines = lines.withColumn("salt", F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id", "code"), F.lit(SALTS))))
    salted = common.select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, SALTS - 1).otherwise(0).cast("long"))).alias("salt"))
    dropped = (
        lines.join(salted, ["h1", "h2", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "code").agg(F.collect_set("pos").alias("drop"))
        .toDF("other_id", "other_code", "drop")
    )
    joined = row.join(dropped, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("code") == F.col("other_code")), "left")
    parts = F.split("body", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    found = {
        text_col: F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept),
        counts[0]: F.size(parts).cast("long"),
        counts[1]: F.coalesce(F.size("drop"), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *(c for c in counts if c not in docs.columns)]
    return joined.select(*(found[c].alias(c) if c in found else F.col("row")[c].alias(c) for c in names))


def op10_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
