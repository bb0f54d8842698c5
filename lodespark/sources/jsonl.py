"""JSON-lines records and graphs, read with a schema and written deterministically.

Malformed lines are dropped or kept in a column, never guessed; a graph's envelope lines are split by type in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

RECORD = "dataset_id string, source string, source_id string, title string, description string, species array<string>, modalities array<string>, tasks array<string>, brain_regions array<string>, license string, doi string, url string, quality_score double, subject_count int, session_count int"


def read_records(spark: SparkSession, path: str, schema: str | StructType = RECORD, required: str = "dataset_id", keep_malformed: bool = False) -> DataFrame:
    """Records of a file or folder (JSON or JSONL, any depth). Rows without the required field are dropped.

    A missing path is an empty table. Malformed lines are dropped, or kept in ``_corrupt_record``.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_malformed:
        fields = StructType([*fields.fields]).add("_corrupt_record", "string")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE" if keep_malformed else "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    return rows if keep_malformed else rows.where(F.col(required).isNotNull())


def write_records(df: DataFrame, path: str, id_col: str = "dataset_id") -> None:
    """One JSON object a line with sorted keys, files in ranges of the id, so the concatenated output is ordered."""
    line = F.to_json(F.struct(*sorted(df.columns))).alias("value")
    df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).select(line).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, nodes, edges) of envelope lines; reading any of them fails on an unknown record type.

    Ids that occur twice fail when nodes or edges are used: the check is a part of their plans.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("kind", F.get_json_object("value", "$.record_type"))
    known = F.when(F.col("kind").isin("metadata", "node", "edge"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce("kind", F.lit("none")))).cast("string"))
    lines = lines.withColumn("kind", known)
    get = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    nodes = lines.where("kind = 'node'").select(get("node_id", "id").alias("node"), get("node_type", "type").alias("ntype"), get("label", "name").alias("label"))
    edges = lines.where("kind = 'edge'").select(get("edge_id", "id").alias("edge_id"), get("source_id", "source").alias("src"), get("target_id", "target").alias("dst"), get("edge_type", "type").alias("etype"), F.coalesce(get("confidence", "weight").cast("double"), F.lit(1.0)).alias("confidence"))
    return lines.where("kind = 'metadata'").select("value"), _unique(nodes, "node"), _unique(edges, "edge_id")


def _unique(rows: DataFrame, key: str) -> DataFrame:
    first = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in rows.columns if c != key))
    once = F.when(F.col("n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key))).cast("string"))
    return first.select(once.alias(key), *(c for c in rows.columns if c != key))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Envelope lines: metadata, nodes, edges, in this order of files."""
    spark = nodes.sparkSession
    meta = spark.createDataFrame([({k: str(v) for k, v in (metadata or {}).items()},)], "m map<string,string>").select(F.lit(0).alias("o"), F.to_json(F.struct(F.lit("metadata").alias("record_type"), "m")).alias("value"))
    n = nodes.select(F.lit(1).alias("o"), F.to_json(F.struct(F.lit("node").alias("record_type"), *nodes.columns)).alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.to_json(F.struct(F.lit("edge").alias("record_type"), *(F.col(c).alias({"src": "source_id", "dst": "target_id", "etype": "edge_type"}.get(c, c)) for c in edges.columns))).alias("value"))
    meta.unionByName(n).unionByName(e).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def export_parquet(tables: dict[str, DataFrame], out: str) -> None:
    """Every table below ``out``, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key is not yet there, each key once: what an idempotent insert adds."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of ``query 0 doc grade`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("query_id"), parts[2].alias("doc_id"), parts[3].cast("int").alias("grade"))
