"""Whole pipelines as plans over tables: recordings to transcripts, books to chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import plugins
from tessera.operators import chapters as ch
from tessera.operators import identity, intervals, text, transcript
from tessera.sources import sinks

PIPELINES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def pipeline(name: str):
    def add(f):
        PIPELINES[name] = f
        return f

    return add


@pipeline("podcast")
def podcast(words: DataFrame, segments: DataFrame | None, media: DataFrame | None = None, names: DataFrame | None = None, summary: str = "heads", chunk_size: int = 15_000) -> dict[str, DataFrame]:
    """Results by kind from words and speaker segments of recordings. What lacks an input is left out."""
    out: dict[str, DataFrame] = {}
    if media is not None:
        out["media.json"] = media
    if segments is None:
        return out
    matched = identity.relabel(segments, names)
    labelled = intervals.align(words, matched)
    lines = transcript.lines(transcript.squish(labelled))
    chunked = text.chunk_recursive(transcript.full(lines), "media_id", chunk_size, text="transcript")
    out |= {
        "transcript.json": labelled,
        "transcript.txt": lines,
        "diarization.json": matched,
        "diarization.rttm": sinks.rttm(matched.withColumn("file", F.concat(F.lit("media_"), "media_id"))),
        "summary.txt": plugins.get("summary", summary)(chunked, key="media_id").withColumn("text_no", F.lit(0)),
    }
    return out


@pipeline("book")
def book(items: DataFrame, names: list[str] | None = None, labels: list[str] | None = None) -> dict[str, DataFrame]:
    """Chapters, their sentences, word counts and entities, and book.json. items: book_id, title, item_no, name, kind, html."""
    nav = items.where("kind = 'navigation'").groupBy("book_id").agg(F.min_by("html", "item_no").alias("nav"))
    documents = ch.single_heading(ch.in_navigation(items.where("kind = 'document'"), nav))
    placed = documents.withColumn("pos", F.row_number().over(W.partitionBy("book_id").orderBy("place", "item_no"))).withColumn("content", ch.paragraphs(F.col("html")))
    chapters = ch.beautify(ch.valid(placed.select("book_id", "pos", "heading", "content"), names).where("valid"))
    texts = chapters.select("book_id", "pos", F.concat_ws("\n", "content").alias("text"))
    sents = plugins.get("splitter", "rules")(texts)
    bags = text.sentence_words(sents, ["book_id", "pos"])
    ents = plugins.get("entities", "rules")(sents, labels=labels)
    spoken = texts.groupBy("book_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)).alias("text"))
    language = plugins.get("language", "votes")(spoken).select("book_id", F.coalesce("language", F.lit("")).alias("language"))
    title = items.groupBy("book_id").agg(F.coalesce(F.first("title", ignorenulls=True), F.lit("No title")).alias("title"))
    shown = chapters.select("book_id", "pos", F.col("heading").alias("heading_raw"), F.col("shown").alias("heading"), "content")
    listed = sents.groupBy("book_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x.sentence).alias("sentences"))
    nested = sinks.nested_entities(ents, ["book_id", "pos", "sent_no"]).groupBy("book_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", F.to_json("ner").alias("j")))), lambda x: x.j).alias("ner"))
    full = shown.join(listed, ["book_id", "pos"], "left").join(nested, ["book_id", "pos"], "left")
    books = title.join(language, "book_id", "left")
    return {
        "books": books,
        "chapters": chapters,
        "sentences": sents,
        "sentence_words": bags,
        "chapter_words": text.rollup(bags, ["book_id", "pos"]),
        "entities": ents,
        "book.json": sinks.book_json(full, F.col("book_id")),
    }
