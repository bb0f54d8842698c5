"""Entity resolution: records that share an identifier are one entity, with a canonical id and a list of conflicts.

Components come from a star for each identifier (its smallest record and the others), so an identifier that very many
records share is a hub and not a clique. Everything about a component is an aggregate over (component, value) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodespark.operators.components import connected_components

#: Fields in which records of one entity may contradict each other.
CONFLICT_FIELDS = ("title", "source", "source_id", "doi", "url")
#: Sources whose records are papers.
PAPER_SOURCES = ("openalex", "pubmed", "crossref", "doi")
_FIELDS = ("dataset_id", "paper_id", "source", "source_id", "doi", "title", "url")


def clean_token(x: Column) -> Column:
    """Lower case; anything but letters, digits and ``. _ : / -`` becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._:/-]+", "_"), "_+", "_"), "^_+|_+$", "")


def bare_doi(x: Column) -> Column:
    """A DOI in lower case without resolver address, prefix, white space and ``. , ;`` at its end."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^(https?://)?(dx\.)?doi\.org/", ""), "^doi:", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(cut)), r"\s+", ""), r"[.,;]+$", "")


def bare_work(x: Column) -> Column:
    """A work's id of the open catalogue in upper case without address and prefix."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^(https?://)?openalex\.org/", ""), "^openalex:", "")
    return F.upper(F.regexp_replace(F.regexp_replace(cut, "^/+|/+$", ""), "(?i)^works/", ""))


def _text(records: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in records.columns else F.lit("")


def identifiers(records: DataFrame, record_col: str = "record_id") -> DataFrame:
    """(record_id, kind, family, value): the identifiers of each record, distinct; kind is dataset, paper or unknown.

    Columns dataset_id, paper_id, source, source_id, doi, title, url, authors (array) and aliases (array) are read where
    they are there. A record with a dataset_id is a dataset; one with a paper_id, DOI or authors a paper; else its source
    decides. Families: dataset_id, paper_id, source, doi, openalex, alias; a record of unknown kind has its own id only.
    """
    c = {n: _text(records, n) for n in _FIELDS}
    source = clean_token(c["source"])
    both = (c["source"] != "") & (c["source_id"] != "")
    authors = F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0 if "authors" in records.columns else F.lit(False)
    kind = F.when(c["dataset_id"] != "", "dataset").when((c["paper_id"] != "") | (c["doi"] != "") | authors, "paper").when(both & source.isin(*PAPER_SOURCES), "paper").when(both, "dataset").otherwise("unknown")
    rows = records.withColumn("kind", kind)
    dataset, paper = F.col("kind") == "dataset", F.col("kind") == "paper"
    pair = lambda on, family, value: F.when(on, F.struct(F.lit(family).alias("family"), value.alias("value")))
    named = F.concat(source, F.lit(":"), c["source_id"])
    catalogue = paper & F.lower(c["paper_id"]).startswith("paper:openalex:")
    found = [
        pair(dataset & (c["dataset_id"] != ""), "dataset_id", c["dataset_id"]), pair(dataset & both, "dataset_id", F.concat(F.lit("dataset:"), named)), pair((dataset | paper) & both, "source", named),
        pair(paper & (c["paper_id"] != ""), "paper_id", c["paper_id"]), pair(catalogue, "openalex", bare_work(F.element_at(F.split(c["paper_id"], ":"), -1))), pair(paper & both, "paper_id", F.concat(F.lit("paper:"), named)),
        pair(paper & both & (source == "openalex"), "openalex", bare_work(c["source_id"])), pair(paper, "doi", bare_doi(c["doi"])), pair(F.col("kind") == "unknown", "unknown", clean_token(F.coalesce(F.col(record_col).cast("string"), F.lit("")))),
    ]
    all_of = F.array_compact(F.array(*found))
    if "aliases" in records.columns:
        aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("family"), clean_token(F.coalesce(a, F.lit(""))).alias("value")))
        all_of = F.concat(all_of, F.when(dataset | paper, aliases).otherwise(F.array().cast("array<struct<family:string,value:string>>")))
    return rows.select(F.col(record_col).alias("record_id"), "kind", F.explode(all_of).alias("i")).select("record_id", "kind", "i.family", "i.value").where("value <> ''").distinct()


def resolve_entities(records: DataFrame, record_col: str = "record_id") -> dict[str, DataFrame]:
    """Tables ``lookup`` (record_id, canonical_id), ``entities`` (canonical_id, entity_type, first_record, n_records,
    n_identifiers, n_aliases), ``identifiers`` (canonical_id, family, value) and ``conflicts`` (canonical_id, field, value, n_records).

    The canonical id is chosen by family over all of an entity's identifiers: for papers DOI, catalogue id, paper_id; for
    datasets dataset_id; otherwise, and where kinds mix, the least ``family:value``; of equals the least. A field conflicts
    if the entity's records have two or more values of it; all values stay, one row each. Records with a null id are left
    out; an empty table gives empty tables.
    """
    own = records.where(F.col(record_col).isNotNull())
    found = identifiers(own, record_col)
    heads = found.groupBy("family", "value").agg(F.min("record_id").alias("head"))
    stars = found.join(heads, ["family", "value"]).where("record_id <> head").select("record_id", "head")
    parts = connected_components(stars, "record_id", "head")
    members = found.select("record_id", "kind").distinct().join(parts, F.col("record_id") == F.col("node"), "left").select("record_id", "kind", F.coalesce("component", "record_id").alias("component"))
    of = found.join(members.select("record_id", "component").distinct(), "record_id")
    values = of.select("component", "family", "value").distinct()
    kinds = members.groupBy("component").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("unknown").alias("entity_type"), F.min("record_id").alias("first_record"), F.countDistinct("record_id").alias("n_records"))
    first = {f: F.min(F.when(F.col("family") == f, F.col("value"))).alias(f) for f in ("doi", "openalex", "paper_id", "dataset_id")}
    least = values.groupBy("component").agg(*first.values(), F.min(F.concat("family", F.lit(":"), "value")).alias("any_id"), F.count(F.lit(1)).alias("n_identifiers"))
    paper = F.when(F.col("entity_type") == "paper", F.coalesce(F.concat(F.lit("paper:doi:"), "doi"), F.concat(F.lit("paper:openalex:"), "openalex"), "paper_id"))
    dataset = F.when(F.col("entity_type") == "dataset", F.col("dataset_id"))
    named = kinds.join(least, "component").withColumn("canonical_id", F.coalesce(paper, dataset, "any_id"))
    ids = named.select("component", "canonical_id")
    lookup = members.select("record_id", "component").distinct()
    placed = own.withColumnRenamed(record_col, "record_id").join(lookup, "record_id")
    titles = placed.select("component", _text(placed, "title").alias("alias"))
    if "aliases" in own.columns:
        titles = titles.unionByName(placed.select("component", F.explode("aliases").alias("alias")))
    aliases = titles.where("alias <> ''").groupBy("component").agg(F.countDistinct("alias").alias("n_aliases"))
    fields = [f for f in CONFLICT_FIELDS if f in own.columns]
    facts = placed.select("component", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), _text(placed, f).alias("value")) for f in fields))).alias("x")).select("component", "x.*").where("value <> ''") if fields else None
    conflicts = None
    if facts is not None:
        counted = facts.groupBy("component", "field", "value").agg(F.count(F.lit(1)).alias("n_records"))
        several = counted.groupBy("component", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        conflicts = counted.join(several, ["component", "field"]).join(ids, "component").select("canonical_id", "field", "value", "n_records")
    entities = named.join(aliases, "component", "left").select("canonical_id", "entity_type", "first_record", "n_records", "n_identifiers", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))
    return {
        "lookup": lookup.join(ids, "component").select("record_id", "canonical_id"), "entities": entities, "identifiers": values.join(ids, "component").select("canonical_id", "family", "value"),
        "conflicts": conflicts if conflicts is not None else entities.select("canonical_id", F.lit("").alias("field"), F.lit("").alias("value"), "n_records").limit(0),
    }
