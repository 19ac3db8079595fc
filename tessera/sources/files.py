"""Media files as tables: discovery, type sniffing, metadata, gold folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import basename, stem


def discover(spark: SparkSession, patterns: list[str], recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of the files of any pattern, each file once. Content is read only if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(patterns)
    return found.dropDuplicates(["path"]) if len(patterns) > 1 else found


def registered(files: DataFrame) -> DataFrame:
    """Distinct files with name, stem and place, the order by (name, path). Other columns stay."""
    named = files.dropDuplicates(["path"]).withColumn("name", basename("path")).withColumn("stem", stem("path"))
    return named.withColumn("place", F.row_number().over(W.orderBy("name", "path")))  # a global order is what is asked for


def kinds() -> dict[str, Column]:
    """What each pipeline accepts, by the first bytes and the extension."""
    head = lambda n: F.substring("content", 1, n)
    text = F.decode(F.substring("content", 1, 64), "iso-8859-1")
    return {
        "podcast": (head(4) == F.lit(b"RIFF")) & (F.substring("content", 9, 4) == F.lit(b"WAVE")),
        "book": (head(2) == F.lit(b"PK")) & F.lower("path").endswith(".epub"),
        "page": F.lower(F.regexp_replace(text, r"^[ \n]+", "")).startswith("<!doctype html"),
    }


def routed(files: DataFrame, accepts: dict[str, Column] | None = None) -> DataFrame:
    """A row per file and pipeline that accepts it; a file that none accepts has the pipeline 'unrecognized'."""
    named = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in (accepts or kinds()).items())), lambda x: x.isNotNull())
    return files.withColumn("pipeline", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("unrecognized")))))


def meta(files: DataFrame) -> DataFrame:
    """Files with name, stem, sha1 of the bytes and bytes, without the content."""
    return files.select("*", basename("path").alias("name"), stem("path").alias("stem"), F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("bytes")).drop("content")


def gold_folder(spark: SparkSession, folder: str) -> DataFrame:
    """name (file stem), path and content of a folder of voice samples; of equal names the last path counts. An empty folder is refused."""
    files = spark.read.format("binaryFile").load(folder)
    if files.isEmpty():
        raise ValueError(f"no samples in {folder}")
    last = files.withColumn("name", stem("path")).withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("path"))))
    return last.where("rn = 1").select("name", "path", "content")
