"""From labelled words to utterances and transcripts; repair of broken word times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import speaker_label


def squish(labelled: DataFrame) -> DataFrame:
    """Runs of words with equal speakers: media_id, utt (from 1), speakers, start_ms, end_ms, text, in order of (turn, pos).

    Gaps and islands in one partitioning by recording: a change of the speakers begins an utterance; both windows and the
    grouping share that partitioning, so there is one shuffle.
    """
    order = W.partitionBy("media_id").orderBy("turn", "pos")
    new = F.when(F.col("speakers").eqNullSafe(F.lag("speakers").over(order)), 0).otherwise(1)
    runs = labelled.withColumn("new", new).withColumn("utt", F.sum("new").over(order))
    at = F.struct("turn", "pos")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", "word"))), lambda x: x.word)
    return runs.groupBy("media_id", "utt").agg(F.first("speakers").alias("speakers"), F.min_by("start_ms", at).alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.trim(F.concat_ws(" ", said)).alias("text"))


def with_label(utterances: DataFrame) -> DataFrame:
    """Utterances with speaker, the readable label."""
    return utterances.withColumn("speaker", speaker_label("speakers"))


def lines(utterances: DataFrame) -> DataFrame:
    """media_id, utt and line, '{speaker} [{start} - {end}]: {text}' with seconds to three places."""
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    return utterances.select("media_id", "utt", F.concat(speaker_label("speakers"), F.lit(" ["), sec("start_ms"), F.lit(" - "), sec("end_ms"), F.lit("]: "), "text").alias("line"))


def full(line_table: DataFrame) -> DataFrame:
    """media_id and transcript, the lines joined in order."""
    return line_table.groupBy("media_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("utt", "line"))), lambda x: x.line)).alias("transcript"))


def repair(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """Words without null times. words: media_id, rn, word, start_ms, end_ms; bounds: media_id, init, fin.

    A word with no start, after a word with no end, melts into the word before; the group's times come from its ends and its
    neighbours. Closed form with windows, no loop:

    - start: the first word's, else the previous word's end, else init, else 0;
    - end: the last word's, else the next group's first start; at the end of the recording fin, or the start if it is one word.
    """
    order = W.partitionBy("media_id").orderBy("rn")
    head = F.when((F.row_number().over(order) == 1) | ~(F.col("start_ms").isNull() & F.lag("end_ms").over(order).isNull()), 1).otherwise(0)
    marked = words.select("*", head.alias("head"), F.lag("end_ms").over(order).alias("before"), F.lead("start_ms").over(order).alias("after"), F.lead("rn").over(order).alias("more")).withColumn("grp", F.sum("head").over(order))
    groups = marked.groupBy("media_id", "grp").agg(
        F.min("rn").alias("rn"),
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x.word)).alias("word"),
        F.min_by("start_ms", "rn").alias("s"),
        F.min_by("before", "rn").alias("before"),
        F.max_by("end_ms", "rn").alias("e"),
        F.max_by("after", "rn").alias("after"),
        F.max_by("more", "rn").alias("more"),
    )
    start = F.coalesce("s", "before", "init", F.lit(0).cast("long"))
    tail = F.when(F.col("more").isNull(), F.when(F.col("n") == 1, start).otherwise(F.col("fin")))
    return groups.join(bounds, "media_id").select("media_id", "rn", "word", start.alias("start_ms"), F.coalesce("e", "after", tail).alias("end_ms"))
