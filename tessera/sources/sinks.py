"""Results as files: JSON, transcripts, RTTM, bundles; errors as data."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}


def writer(kind: str):
    """Register a writer (df, path) for a kind of result."""

    def add(f):
        WRITERS[kind] = f
        return f

    return add


def store(results: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each result below folder by the writer of its kind; a result that is there already is refused. Returns the paths."""
    paths = []
    for kind, df in results.items():
        if kind not in WRITERS:
            raise KeyError(f"no writer for {kind}")
        WRITERS[kind](df, f"{folder}/{kind}")
        paths.append(f"{folder}/{kind}")
    return paths


def folder_name(file: str, at) -> str:
    """Folder of a file's results, by its stem and the time."""
    return f"{Path(file).stem}_{at:%Y-%m-%d_%H-%M-%S}"


def pack(folder: str, keep: bool = False) -> str:
    """Zip a finished local folder; remove it unless it is kept."""
    made = shutil.make_archive(folder, "zip", folder)
    if not keep:
        shutil.rmtree(folder)
    return made


def rttm(segments: DataFrame) -> DataFrame:
    """media_id, line_no and line in RTTM order (from, to, speaker). segments: media_id, file, speaker, from_ms, to_ms."""
    order = W.partitionBy("media_id").orderBy("from_ms", "to_ms", F.asc_nulls_first("speaker"))
    sec = lambda c: F.format_string("%.3f", c / 1000.0)
    line = F.concat_ws(" ", F.lit("SPEAKER"), "file", F.lit("1"), sec(F.col("from_ms")), sec(F.col("to_ms") - F.col("from_ms")), F.lit("<NA> <NA>"), F.coalesce("speaker", F.lit("<NA>")), F.lit("<NA> <NA>"))
    return segments.select("media_id", F.row_number().over(order).alias("line_no"), line.alias("line"))


def book_json(chapters: DataFrame, title: Column) -> DataFrame:
    """book_id and book: title and chapters in order of pos as JSON; null fields drop out. Columns but book_id and pos go in."""
    fields = [c for c in chapters.columns if c not in ("book_id", "pos")]
    parts = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("c")))).alias("p"))
    return parts.select("book_id", F.to_json(F.struct(title.alias("title"), F.transform("p", lambda x: x.c).alias("chapters"))).alias("book"))


def guarded(df: DataFrame, value: Column, name: str, error: str) -> DataFrame:
    """df with a value that may fail (is null) and error, null where it is there."""
    return df.withColumn(name, value).withColumn("error", F.when(F.col(name).isNull(), F.lit(error)))


def parted(guarded_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with an error)."""
    return guarded_rows.where("error is null").drop("error"), guarded_rows.where("error is not null")


def nested_entities(entities: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ner: label -> spans of (ent, from, to)."""
    spans = entities.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("from", "to", "ent"))).alias("s"))
    shaped = spans.select(*keys, "label", F.transform("s", lambda x: F.struct(x["ent"].alias("ent"), x["from"].alias("from"), x["to"].alias("to"))).alias("s"))
    return shaped.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "s")))).alias("ner"))


def _text(column: str, order: list[str]):
    def write(df: DataFrame, path: str) -> None:
        df.repartition("media_id").sortWithinPartitions("media_id", *order).select("media_id", F.col(column).alias("value")).write.partitionBy("media_id").mode("errorifexists").text(path)

    return write


WRITERS["transcript.txt"] = _text("line", ["utt"])
WRITERS["diarization.rttm"] = _text("line", ["line_no"])


@writer("summary.txt")
def summary_text(df: DataFrame, path: str) -> None:
    """Summaries of a recording joined by a line of dashes. df: media_id, text_no, summary."""
    joined = df.groupBy("media_id").agg(F.concat_ws("\n---\n", F.transform(F.array_sort(F.collect_list(F.struct("text_no", "summary"))), lambda x: x.summary)).alias("value"))
    joined.write.partitionBy("media_id").mode("errorifexists").text(path)


@writer("transcript.json")
def transcript_json(df: DataFrame, path: str) -> None:
    """A line per word. df: labelled words."""
    df.select("media_id", F.col("speakers").alias("speaker"), "word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("finish")).write.partitionBy("media_id").mode("errorifexists").json(path)


@writer("diarization.json")
def diarization_json(df: DataFrame, path: str) -> None:
    """Speaker -> spans. A missing speaker is '<Unknown>', since a map's key can't be null."""
    spans = df.groupBy("media_id", F.coalesce("speaker", F.lit("<Unknown>")).alias("speaker")).agg(F.array_sort(F.collect_list(F.array(F.col("from_ms") / 1000.0, F.col("to_ms") / 1000.0))).alias("s"))
    spans.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "s")))).alias("diarization")).write.partitionBy("media_id").mode("errorifexists").json(path)


@writer("media.json")
def media_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


@writer("book.json")
def book_file(df: DataFrame, path: str) -> None:
    df.select(F.col("book").alias("value"), "book_id").write.partitionBy("book_id").mode("errorifexists").text(path)


@writer("meta.json")
def meta_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
