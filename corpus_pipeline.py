"""A corpus pipeline over ``documents``: language ID, exact dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; the
caller writes it as Parquet and reads it again as the next stage's ``docs``. All but the last return the columns of
``documents``. Tables may have more columns; stages before the last pass them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodespark.llm import byte_bpe, exact_dedup, language, mixing, near_dedup
from lodespark.llm.common import fresh_dir, keyed, table
from lodespark.session import prepare


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame, of: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in of.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language can be told; those that are null or have no letter (``und``) go.

    A low score is no reason to go: short clean texts have one.
    """
    prepare(spark)
    model = language.train_on(docs)
    return language.keep_known(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only the document with the largest id stays; rows that repeat it in full stay together.

    Null texts count as empty; a null id stays only if no other document has its text. An empty table stays empty.
    """
    prepare(spark)
    name, digest, own = (_fresh(docs, x) for x in ("kept_id", "kept_sha256", "own_sha256"))
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest)).distinct()
    rows = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    return _columns(rows.join(kept, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own) == F.col(digest)), "left_semi"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Documents without words link with nothing and stay. Rows with a null id are documents of their own after all others.
    An empty table stays empty.
    """
    prepare(spark)
    name, own = _fresh(docs, "gone_id"), _fresh(docs, "row_key")
    rows, _ = keyed(docs, "doc_id", own)
    gone = near_dedup.near_duplicates(rows, id_col=own).where("NOT kept").select(F.col(own).alias(name)).distinct()
    return _columns(rows.join(gone, F.col(own) == F.col(name), "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of each document as the mix takes; a part of a copy counts if it is at least half of one.

    Documents without words are taken no times and go; a null source is a source of its own. Rows with one id are told
    apart by their sizes only. An empty table stays empty.
    """
    prepare(spark)
    own, size, copies, mine, copy = (_fresh(docs, x) for x in ("mix_id", "mix_size", "mix_copies", "own_size", "copy_number"))
    mix = mixing.pareto_mix(docs.select("doc_id", "text", "source")).where("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    mix = mix.select(F.col("doc_id").alias(own), F.col("size").alias(size), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies)).where(f"{copies} > 0")
    rows = docs.withColumn(mine, mixing.words(F.col("text"))).join(mix, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mine) == F.col(size)))
    return _columns(rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's whole text: (doc_id, n_tokens, ids). Null texts are empty and have no ids; an empty table stays empty."""
    prepare(spark)
    rows = docs.select("doc_id", "text")
    coded = byte_bpe.encode_texts(rows, *byte_bpe.default_vocabulary())
    whole = F.when(F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text")).cast("binary"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), whole.alias("ids"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID, near-dedup and encoding have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
