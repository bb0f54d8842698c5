"""Concepts of records: token sets of terms that contain each other, and slugs of fields.

Containment is an equi-join in both directions on one token of the contained set. Concepts go to the records unless
there are very many token sets of theirs, so records' token sets are not shuffled; only their matches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Token sets of concepts that are sent to every task.
SENT = 200_000


def token_set(term: Column) -> Column:
    """The sorted distinct words of a term in lower case, underscores and hyphens as spaces; empty for a null term or one without words."""
    words = F.split(F.translate(F.lower(F.coalesce(term, F.lit(""))), "_-", "  "), r"(?U)\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def contained_concepts(records: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct (record, concept) of (record, term) and (concept, term) rows.

    A concept matches if the words of one of its terms are all among those of one of the record's terms, or the other way
    round; equal terms do both. Terms without words, null ones too, match nothing, nor do rows without a record or concept.
    Other columns are not read; an empty table matches nothing.
    """
    r = records.where("record IS NOT NULL").select("record", token_set(F.col("term")).alias("tokens")).where(F.size("tokens") > 0)
    c = concepts.where("concept IS NOT NULL").select("concept", token_set(F.col("term")).alias("of_concept")).where(F.size("of_concept") > 0)
    c = c.groupBy("of_concept").agg(F.collect_set("concept").alias("concepts"))
    to_all = F.broadcast if c.limit(SENT + 1).count() <= SENT else lambda t: t
    words = c.select("of_concept", "concepts", F.explode("of_concept").alias("word"))
    # a set with a word that no record has is in none; of the others the rarest word is the key
    count = r.select(F.explode("tokens").alias("word")).join(to_all(words.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keys = words.join(count, "word").groupBy("of_concept").agg(F.first("concepts").alias("concepts"), F.min(F.struct("n", "word")).alias("least"), F.count(F.lit(1)).alias("found"))
    keys = keys.where(F.col("found") == F.size("of_concept")).select("of_concept", "concepts", F.col("least.word").alias("word"))
    below = r.select("record", "tokens", F.explode("tokens").alias("word")).join(to_all(keys), "word").where(F.size(F.array_except("of_concept", "tokens")) == 0)
    # every word of a record's set is in the sets around it: the longest, as a rule a rare one, is its key
    longest = F.array_max(F.transform("tokens", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    above = r.select("record", "tokens", longest.alias("word")).join(to_all(words), "word").where(F.size(F.array_except("tokens", "of_concept")) == 0)
    return below.select("record", "concepts").union(above.select("record", "concepts")).select("record", F.explode("concepts").alias("concept")).distinct()


def field_slugs(records: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Distinct (record, concept): ``prefix:slug`` of each value of the array columns; space, hyphen and slash become an underscore."""
    empty = F.array().cast("array<string>")

    def slugs(column: str, prefix: str) -> Column:
        return F.transform(F.coalesce(F.col(column), empty), lambda v: F.struct(F.lit(prefix).alias("prefix"), F.translate(F.lower(F.trim(v)), " -/", "___").alias("slug")))

    values = F.flatten(F.array(*(slugs(c, p) for c, p in prefixes.items())))
    rows = records.where("record IS NOT NULL").select("record", F.explode(values).alias("x")).where("x.slug <> ''")
    return rows.select("record", F.concat_ws(":", "x.prefix", "x.slug").alias("concept")).distinct()


def concept_index(records: DataFrame, concepts: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Distinct (record, concept) of (record, fields that ``prefixes`` names): matched concepts of the fields' values, and their slugs."""
    empty = F.array().cast("array<string>")
    terms = records.select("record", F.explode(F.flatten(F.array(*(F.coalesce(F.col(c), empty) for c in prefixes)))).alias("term"))
    return contained_concepts(terms, concepts).union(field_slugs(records, prefixes)).distinct()
