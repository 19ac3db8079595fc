"""Chapters of books: items, headings, validity, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import roman, strip

SPECIAL = ("prologue", "introduction", "epilogue", "prolog", "epilog")


def _clean(html) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")


def _text(html) -> Column:
    """Text of a piece of HTML: no tags, the usual entities decoded."""
    t = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


def headings(html) -> Column:
    """Texts of h1 to h6 in document order."""
    return F.transform(F.regexp_extract_all(_clean(html), F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>"), 1), _text)


def paragraphs(html) -> Column:
    """Texts of the p elements in document order; one that isn't closed ends at the next p or block, as a browser reads it."""
    marked = F.regexp_replace(_clean(html), r"(?i)</?(?:p|div|article|section|aside|main|nav|footer|header|ul|ol|table|h[1-6]|body|html)(?=[\s>])[^>]*>", "\u0001$0")
    pieces = F.filter(F.split(marked, "\u0001"), lambda x: F.lower(F.substring(x, 1, 3)).isin("<p>", "<p "))
    return F.transform(pieces, _text)


def in_navigation(items: DataFrame, nav: DataFrame) -> DataFrame:
    """Items whose name occurs in their book's navigation document, with place (the first occurrence)."""
    return items.join(nav, "book_id").withColumn("place", F.instr("nav", F.col("name"))).where("place > 0").drop("nav")


def single_heading(items: DataFrame) -> DataFrame:
    """Items with exactly one heading that isn't empty, with heading (stripped)."""
    h = items.withColumn("h", headings(F.col("html")))
    return h.where("size(h) = 1 and length(get(h, 0)) > 0").withColumn("heading", strip(F.get("h", F.lit(0)))).drop("h")


def valid(chapters: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Chapters with valid: a listed name, a number, a heading that repeats (as it is or in lower case), a special name, or 'chapter N'.

    Counting is one window by book and heading; the count of the lower-case form comes from a join with the distinct headings.
    """
    counts = chapters.groupBy("book_id", F.col("heading").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    lower = counts.select("book_id", F.col("h").alias("low"), F.col("n").alias("n_low"))
    c = counts.withColumn("low", F.lower("h")).join(lower, ["book_id", "low"], "left")
    listed = F.lower(strip("h")).isin([x.strip().lower() for x in names]) if names else F.lit(False)
    ok = listed | F.col("h").rlike(r"^\p{N}+$") | (F.col("n") > 1) | (F.coalesce("n_low", F.lit(0)) > 1) | F.lower("h").isin(*SPECIAL) | F.lower("h").rlike(r"^(chapter|kapitel) \p{Nd}+$")
    marked = c.select("book_id", F.col("h").alias("heading"), ok.alias("valid"))
    return chapters.join(marked, ["book_id", "heading"])


def beautify(chapters: DataFrame) -> DataFrame:
    """Chapters with heading_beautified (a repeated heading with a Roman number, else null) and shown (that, or the heading)."""
    same = W.partitionBy("book_id", "heading")
    n = F.count(F.lit(1)).over(same)
    k = F.row_number().over(same.orderBy("pos"))
    pretty = chapters.withColumn("heading_beautified", F.when(n > 1, F.concat("heading", F.lit(" "), roman(k))))
    return pretty.withColumn("shown", F.coalesce("heading_beautified", "heading"))
