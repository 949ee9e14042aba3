"""Files as tables: strict JSON lines, inventories with digests, canonical JSON and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions.strict_json import json_fault
from tallyforge.session import ship


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of JSON-lines files under path, read with a fixed schema.

    faults: file, fault, line text of every line that strict reading rejects; such lines are no rows.
    """
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    judged = lines.withColumn("fault", json_fault(F.col("line")))
    rows = judged.where("fault is null").select(F.from_json("line", schema).alias("_r")).select("_r.*")
    return rows, judged.where("fault is not null").select("file", "fault", "line")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of files that each hold one JSON array, read with a fixed schema; what does not parse gives rows of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def inventory(spark: SparkSession, path: str, glob: str = "*", without: str | None = None) -> DataFrame:
    """path, length, sha256 of every file below a folder, but for paths that match the pattern `without`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    if without:
        files = files.where(~F.col("path").rlike(without))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, path: str, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(texts, refused) of the files below a folder: path and text as UTF-8, broken bytes replaced; and path, length of files of
    more than `most` bytes, which are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small, large = files.where(F.col("length") <= most), files.where(F.col("length") > most)
    return small.select("path", F.col("content").cast("string").alias("text")), large.select("path", "length")


def manifest_digests(files: DataFrame) -> DataFrame:
    """folder, n_files, sha256: per folder one digest over its sorted `digest  path` lines; a folder's listing fits a task."""
    line = F.concat_ws("  ", "sha256", "path")
    folder = F.regexp_replace("path", r"/[^/]*$", "").alias("folder")
    return files.groupBy(folder).agg(F.count("*").alias("n_files"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("sha256"))


def write_canonical_json(df: DataFrame, path: str, key: str) -> None:
    """JSON lines with sorted fields, ordered by key over all files: equal rows give equal bytes however they are spread."""
    fields = [F.col(c) for c in sorted(df.columns)]
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    ordered.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, chunk: str) -> DataFrame:
    """One folder of JSON files per chunk, and an index of them in `_index`: chunk, n_rows. Returns the index."""
    df.write.mode("overwrite").partitionBy(chunk).json(path)
    index = df.groupBy(chunk).agg(F.count("*").alias("n_rows"))
    index.coalesce(1).write.mode("overwrite").json(f"{path}/_index")
    return index


def write_valid(df: DataFrame, path: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """Canonical JSON of df, written only if no row breaks a check; returns the violations (table_name, key, check), none if it was written."""
    from tallyforge.operators.quality import violations

    broken = violations(df, path, F.col(key).cast("string"), checks)
    if broken.isEmpty():
        write_canonical_json(df, path, key)
    return broken


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old with those of new put in their place or added, by key; of repeated new keys the last by content hash wins."""
    from tallyforge.operators.timeline import latest

    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, ["_v"]).drop("_v")
