"""Records as JSON lines: export in a fixed order, import that names what is wrong with a line, and comparison with a journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.records import canonical, content_hash

# Bytes of a line at most, the format's version.
LINE_BYTES, VERSION = 1 << 20, 1
FIELDS = "kind string, id string, version int, project_id string, payload string, hash string, supersedes_id string"


def encoded(rows: DataFrame, kind: str, key: str, project: str, **payload: str) -> DataFrame:
    """``kind, id, value`` lines of rows; the payload's columns by name, nulls left out, and its hash."""
    body = canonical(**{k: F.col(c) for k, c in payload.items()})
    record = canonical(kind=F.lit(kind), id=F.col(key).cast("string"), version=F.lit(VERSION), project_id=F.col(project), payload=body, hash=content_hash(body))
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), record.alias("value"))


def export(lines: DataFrame, path: str) -> None:
    """Lines in (kind, id) order, range by range, so that no task holds them all; the part files in name order are one sorted file."""
    lines.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").select("value").write.text(path)


def read(spark: SparkSession, path: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Records and issues ``(file, value_sha256, issue)`` of a folder of lines. Blank lines are skipped; a bad line is an issue and stops nothing."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    long = F.octet_length("value") > LINE_BYTES
    rows = lines.withColumn("r", F.when(~long, F.from_json("value", FIELDS)))
    issue = (
        F.when(long, "line_too_long")
        .when(F.col("r.kind").isNull() | F.col("r.id").isNull(), "malformed")
        .when(F.col("r.version") > VERSION, "future_version")
        .when(F.col("r.project_id") != project_id, "foreign_project")
        .when(content_hash(F.col("r.payload")) != F.col("r.hash"), "hash_mismatch")
    )
    rows = rows.withColumn("issue", issue)
    return rows.where("issue is null").select("r.*"), rows.where("issue is not null").select("file", F.sha2("value", 256).alias("value_sha256"), "issue")


def decoded(records: DataFrame) -> DataFrame:
    """Imported records: their source is the import, and they start without trust whatever they claim."""
    return records.withColumn("source", F.lit("import")).withColumn("trust_state", F.lit("quarantined"))


def compared(records: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``outcome``: new, duplicate or conflict with known ``(id, hash)``, or with another line of the import."""
    each = records.dropDuplicates(["kind", "id", "hash"])
    w = Window.partitionBy("kind", "id")
    each = each.withColumn("versions", F.count(F.lit(1)).over(w))
    joined = each.join(known.select("id", F.col("hash").alias("known_hash")), "id", "left")
    outcome = F.when(F.col("known_hash") == F.col("hash"), "duplicate").when(F.col("known_hash").isNotNull() | (F.col("versions") > 1), "conflict").otherwise("new")
    return joined.withColumn("outcome", outcome).drop("known_hash", "versions")
