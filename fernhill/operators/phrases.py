"""Vocabulary lookups, bullets, highlights and phrase dictionaries over batches of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernhill.functions.text import norm_alnum, norm_bullet, whole_words

BOOLEANS = (("true", "yes"), ("false", "no"))


def norm_enum(traits: DataFrame, vocab: DataFrame, aliases: DataFrame) -> DataFrame:
    """Trait values in the vocabulary's spelling (field, value), by case, then alias (alias, target), then booleans.

    What matches nothing is ``unknown`` where the field allows it, else empty.
    """
    allowed = vocab.select("field", F.lower("value").alias("lower_value"), F.col("value").alias("exact"))
    unknown = vocab.where("lower(value) = 'unknown'").select("field", F.lit(True).alias("has_unknown")).distinct()
    named = aliases.select(F.lower("alias").alias("lower_value"), F.lower("target").alias("target"))
    yes_no = F.coalesce(*(F.when(F.lower("value") == a, b) for a, b in BOOLEANS))
    rows = traits.withColumns({"lower_value": F.lower(F.trim("value")), "yes_no": yes_no}).join(allowed, ["field", "lower_value"], "left")
    rows = rows.join(named, "lower_value", "left")
    second = allowed.select("field", F.col("lower_value").alias("wanted"), F.col("exact").alias("by_alias"))
    rows = rows.withColumn("wanted", F.coalesce("target", "yes_no")).join(second, ["field", "wanted"], "left").join(unknown, "field", "left")
    out = F.coalesce("exact", "by_alias", F.when(F.col("has_unknown"), "unknown").otherwise(""))
    return rows.select(*traits.columns, out.alias("normalized"))


def parse_bullets(bullets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bullets 'Label: value' with their field by label (label, field), or null where the label is unknown."""
    parts = F.split("text", ":", 2)
    rows = bullets.withColumns({"label": norm_alnum(F.get(parts, F.lit(0))), "value": F.trim(F.get(parts, F.lit(1)))})
    return rows.join(labels.select(norm_alnum(F.col("label")).alias("label"), "field"), "label", "left").drop("label")


def pixel_type(products: DataFrame, decisions: DataFrame, table: DataFrame) -> DataFrame:
    """The type of each grouping: a decision first, then the table, else SKIP."""
    rows = products.join(decisions.select("grouping", F.col("visual_type").alias("decided")), "grouping", "left").join(table.select("grouping", F.col("visual_type").alias("tabled")), "grouping", "left")
    return rows.withColumn("pixel_type", F.coalesce("decided", "tabled", F.lit("SKIP"))).drop("decided", "tabled")


def image_cap(products: DataFrame, caps: DataFrame, soft: int = 8, hard: int = 15) -> DataFrame:
    rows = products.join(caps.select("visual_type", F.col("cap").alias("own_cap")), "visual_type", "left")
    return rows.withColumn("cap", F.least(F.coalesce("own_cap", F.lit(soft)), F.lit(hard)).cast("long")).drop("own_cap")


def compatible_types(rows: DataFrame, families: DataFrame) -> DataFrame:
    """A row per type that is interchangeable with a record's own (families: visual_type, family)."""
    own = families.select("visual_type", F.col("family").alias("f"))
    other = families.select(F.col("visual_type").alias("compatible"), F.col("family").alias("f"))
    return rows.join(own.join(other, "f").drop("f"), "visual_type")


def trait_flags(queries: DataFrame, dictionary: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A column per trait: the value of its first (trait, pattern, value) that the text matches, else null."""
    out = {}
    for trait in dict.fromkeys(t for t, _, _ in dictionary):
        col = None
        for t, pattern, value in dictionary:
            if t == trait:
                col = F.when(F.lower("text").rlike(pattern), value) if col is None else col.when(F.lower("text").rlike(pattern), value)
        out[trait] = col
    return queries.withColumns(out)


def category_noun(rows: DataFrame, nouns: Sequence[str], within: int = 10) -> DataFrame:
    """The longest noun among the first words of a text."""
    head = F.concat(F.lit(" "), F.array_join(F.slice(F.split(norm_alnum(F.col("text")), " "), 1, within), " "), F.lit(" "))
    hits = F.array_compact(F.array(*(F.when(F.contains(head, F.lit(f" {n} ")), F.lit(n)) for n in sorted(nouns, key=lambda n: (-len(n), n)))))
    return rows.withColumn("noun", F.get(hits, F.lit(0)))


def field_priority(rows: DataFrame, listed: DataFrame, fallback: str) -> DataFrame:
    """``rows`` (visual_type, field, ...) with ``priority`` by the list (visual_type, field, priority), normal by default.

    A type that the list does not know has the priorities of the ``fallback`` type.
    """
    known = listed.select("visual_type").distinct().withColumn("known", F.lit(True))
    typed = rows.join(known, "visual_type", "left").withColumn("listed_type", F.when(F.col("known"), F.col("visual_type")).otherwise(fallback))
    found = typed.join(listed.withColumnRenamed("visual_type", "listed_type"), ["listed_type", "field"], "left")
    return found.withColumn("priority", F.coalesce("priority", F.lit("normal"))).drop("known", "listed_type")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(F.lower(text), F.lit(p))
    return hit


def strip_phrase(text: Column, phrase: Column) -> Column:
    """The text without a phrase, and without punctuation or 'with' at its start."""
    left = F.trim(F.replace(F.lower(text), F.lower(phrase), F.lit(" ")))
    return F.trim(F.regexp_replace(F.regexp_replace(left, r"\s+", " "), r"^[\s,.;:]*(with )?", ""))


def matched_phrases(phrases: DataFrame, wanted: DataFrame, top: int = 3) -> DataFrame:
    """(record_id, phrase, score, place): 3 x shared tokens + salience + 0.1 x tokens, the best of each record.

    phrases: (record_id, phrase, salience, tokens); wanted: (record_id, wanted tokens).
    """
    rows = phrases.join(wanted, "record_id")
    score = 3 * F.size(F.array_intersect("tokens", "wanted")) + F.col("salience") + 0.1 * F.size("tokens")
    w = W.partitionBy("record_id").orderBy(F.desc("score"), "phrase")
    return rows.select("record_id", "phrase", F.round(score, 6).alias("score")).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top)


# Words and patterns that decide what a bullet is worth.
LOW_VALUE = ("chair", "table", "sofa", "stool", "bench", "desk", "furniture", "modern design", "contemporary design", "minimalist design", "four legs", "4 legs")
OBJECT_NOUNS = ("chair", "table", "sofa", "stool", "bench", "desk", "seat", "furniture")
COMPONENT_NOUNS = ("leg", "legs", "base", "frame", "back", "backrest", "arm", "arms", "armrest", "armrests", "seat", "shell", "top", "panel", "panels", "cushion", "cushions")
MATERIAL_WORDS = ("wood", "wooden", "metal", "steel", "aluminum", "aluminium", "chrome", "fabric", "textile", "leather", "mesh", "glass", "stone", "plastic", "upholstered")
QUALIFIER_WORDS = ("angled", "curved", "rounded", "tapered", "slender", "thick", "thin", "tubular", "integrated", "wraparound", "open", "closed", "compact", "monolithic", "floating")
ABSTRACT_TERMS = ("design", "aesthetic", "style", "silhouette", "presence", "look", "appearance", "feel")
STOP_WORDS = ("a", "an", "and", "or", "the", "with", "without", "of", "on", "in", "to", "for")
SAME_WORDS = (("backrest", "back"), ("armrest", "arm"), ("curved", "curve"), ("rounded", "round"), ("angled", "angle"), ("tall", "high"))
COUNTED_PARTS = r"\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\b.*\b(leg|caster|wheel|arm)\b"
_COUNTED = whole_words("one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+") + ".*" + whole_words("leg|caster|wheel|arm")
COMPONENT_GROUPS = (
    ("leg", "legs"), ("base|plinth|pedestal", "base"), ("frame", "frame"), ("back|backrest", "back"), ("arm|arms|armrest", "arms"), ("seat|cushion", "seat"), ("shell", "shell"),
    ("top|tabletop", "top"), ("material|wood|metal|fabric|leather|mesh", "material"), ("curved|rounded|boxy|angular|monolithic|floating|compact|tall", "form"),
)


def _words(bullet: Column) -> Column:
    return F.filter(F.split(bullet, " "), lambda w: w != "")


def _among(words: Column, listed: Sequence[str]) -> Column:
    """How many of the words are listed, repeated ones as often as they come."""
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def component_group(bullet: Column) -> Column:
    """The part that a bullet is about, by its first matching rule, or ``misc``."""
    out = None
    for words, group in COMPONENT_GROUPS:
        hit = bullet.rlike(whole_words(words))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("misc")


def bullet_score(bullet: Column) -> Column:
    """3 for each material and component word, 2 for each qualifier, 1 from three words on, 1 more from five."""
    words = _words(bullet)
    n = F.size(words)
    return (3 * _among(words, MATERIAL_WORDS) + 3 * _among(words, COMPONENT_NOUNS) + 2 * _among(words, QUALIFIER_WORDS) + (n >= 3).cast("int") + (n >= 5).cast("int")).cast("int")


def low_value_bullet(bullet: Column) -> Column:
    """Blocked words, counted parts, a bare object noun, or three words or more that are abstract only."""
    words = _words(bullet)
    n = F.size(words)
    abstract = (_among(words, ABSTRACT_TERMS) > 0) & (_among(words, MATERIAL_WORDS) == 0) & (_among(words, COMPONENT_NOUNS) <= 1) & (n >= 3)
    return (F.coalesce(bullet, F.lit("")) == "") | bullet.isin(*LOW_VALUE) | bullet.rlike(_COUNTED) | ((n <= 2) & (_among(words, OBJECT_NOUNS) > 0)) | abstract


def compare_tokens(bullet: Column) -> Column:
    """Words for overlap: without stop words, some forms as one."""
    words = F.split(F.regexp_replace(F.lower(bullet), r"[^a-z0-9\s-]", " "), r"\s+")

    def same(w):
        out = None
        for form, word in SAME_WORDS:
            out = F.when(w == form, word) if out is None else out.when(w == form, word)
        return out.otherwise(w)

    return F.filter(F.transform(words, same), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def clean_highlights(bullets: DataFrame, keep: int = 8) -> DataFrame:
    """(record_id, highlights): bullets (record_id, ord, text) in their order, without low-value ones and overlaps.

    Bullets overlap if one holds the other, if they are about the same part and share two words, or if
    they share 0.7 of the longer one's words. Of two that overlap the higher score stays, at the place
    of the first. Repeated bullets count once. The fold runs over one record's few bullets inside an
    expression; records without a bullet left have none.
    """
    # all grouping is within a record, whose rows are dealt once; a text is normalized once before it is judged,
    # and not again for each rule: filters do not move below an explode
    texts = bullets.repartition("record_id").groupBy("record_id", "text").agg(F.min("ord").alias("ord"))
    rows = texts.select("record_id", "ord", F.explode(F.array(norm_bullet(F.col("text")))).alias("norm"))
    rows = rows.groupBy("record_id", "norm").agg(F.min("ord").alias("ord")).where(~low_value_bullet(F.col("norm")))
    item = F.struct("ord", "norm", component_group(F.col("norm")).alias("part"), compare_tokens(F.col("norm")).alias("tokens"), bullet_score(F.col("norm")).alias("score"))
    lists = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)

    def overlaps(x, k):
        shared = F.size(F.filter(x["tokens"], lambda t: F.array_contains(k["tokens"], t)))
        longer = F.greatest(F.size(x["tokens"]), F.size(k["tokens"]), F.lit(1))
        return F.contains(x["norm"], k["norm"]) | F.contains(k["norm"], x["norm"]) | ((x["part"] == k["part"]) & (x["part"] != "misc") & (shared >= 2)) | (shared / longer >= 0.7)

    def add(kept, x):
        found = F.array_position(F.transform(kept, lambda k: overlaps(x, k)), F.lit(True))
        replaced = lambda at: F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["score"] > k["score"]), x).otherwise(k))
        # the place is bound to a name, so that it is not sought again for each kept bullet
        return F.get(F.transform(F.array(found), lambda at: F.when(at == 0, F.concat(kept, F.array(x))).otherwise(replaced(at))), F.lit(0))

    return lists.select("record_id", F.transform(F.slice(F.aggregate("items", empty, add), 1, keep), lambda k: k["norm"]).alias("highlights"))


def observation_audit(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(record_id, issues): names of the SQL conditions that hold, in their order."""
    return rows.select("record_id", F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in rules))).alias("issues"))


def finish_fallback(rows: DataFrame, finishes: Sequence[tuple[str, str]]) -> DataFrame:
    """Blank finishes filled from name keywords, the first (pattern, finish) that matches."""
    found = None
    for pattern, finish in finishes:
        found = F.when(F.lower("product_name").rlike(pattern), finish) if found is None else found.when(F.lower("product_name").rlike(pattern), finish)
    return rows.withColumn("finish", F.when(F.col("finish").isin("", "unknown"), F.coalesce(found, F.lit("unknown"))).otherwise(F.col("finish")))


def top_examples(pairs: DataFrame, n_pairs: int = 15, n_examples: int = 5) -> DataFrame:
    """The most frequent pairs (a, b) with their first examples."""
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(n_pairs)
    placed = pairs.join(counts, ["a", "b"]).withColumn("k", F.row_number().over(W.partitionBy("a", "b").orderBy("id"))).where(F.col("k") <= n_examples)
    return placed.groupBy("a", "b", "n").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("examples"))
