"""The engine's logical inputs derived from the general tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import LADDER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, turn, pos, word, start_ms, end_ms: words of conversations, 100 ms and 20 ms a letter each, end to end."""
    c = table(spark, sf_dir, "conversations")
    w = c.select(F.col("conv_id").alias("media_id"), "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    ms = (F.lit(100) + 20 * F.length("word")).cast("long")
    end = F.sum(ms).over(W.partitionBy("media_id").orderBy("turn", "pos"))
    return w.select("*", (end - ms).alias("start_ms"), end.alias("end_ms"))


def segments(spark: SparkSession, sf_dir: str, w: DataFrame | None = None) -> DataFrame:
    """media_id, turn, speaker, from_ms, to_ms: one shifted segment for most turns."""
    w = words(spark, sf_dir) if w is None else w
    roles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"))
    spans = w.groupBy("media_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e")).where("(media_id + turn) % 7 <> 0 and e - s > 800")
    return spans.join(roles, ["media_id", "turn"]).select(
        "media_id",
        "turn",
        "speaker",
        F.expr("greatest(0L, s - ((media_id * 7 + turn * 13) % 5) * 150)").alias("from_ms"),
        F.expr("e + ((media_id * 3 + turn * 11) % 4) * 200 - ((media_id + turn) % 3) * 400").alias("to_ms"),
    )


WORDS_SQL = r"""
w0 as (select conv_id as media_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as l from conversations),
w1 as (select media_id, turn, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as word from w0),
words as (select *, (e - d)::bigint as start_ms, e as end_ms from (select *, 100 + 20 * length(word) as d, sum(100 + 20 * length(word)) over (partition by media_id order by turn, pos)::bigint as e from w1))"""

SEGMENTS_SQL = """
spans as (select media_id, turn as t, min(start_ms) as s, max(end_ms) as e from words group by 1, 2),
segments as (select media_id, t as turn, role as speaker, greatest(0, s - ((media_id * 7 + t * 13) % 5) * 150)::bigint as from_ms, (e + ((media_id * 3 + t * 11) % 4) * 200 - ((media_id + t) % 3) * 400)::bigint as to_ms
  from spans join conversations c on c.conv_id = media_id and c.turn = t where (media_id + t) % 7 <> 0 and e - s > 800)"""

FRACTION_SQL = "case when start_ms > to_ms or end_ms < from_ms or least(end_ms, to_ms) = greatest(start_ms, from_ms) then 0.0::double else (least(end_ms, to_ms) - greatest(start_ms, from_ms))::double / (end_ms - start_ms)::double end"

LADDER_SQL = "[" + ", ".join(f"{x!r}::double" for x in LADDER) + "]"

ALIGNED_SQL = f"""
fractions as (select w.media_id, w.turn, w.pos, s.speaker, max({FRACTION_SQL}) as g from words w join segments s on s.media_id = w.media_id and s.from_ms <= w.end_ms and s.to_ms >= w.start_ms group by 1, 2, 3, 4),
tops as (select media_id, turn, pos, max(g) as top from fractions group by 1, 2, 3),
steps as (select *, list_max(list_filter({LADDER_SQL}, lambda x: x <= top)) as step from tops),
chosen as (select f.media_id, f.turn, f.pos, list_sort(list(distinct speaker)) as speakers from fractions f join steps s on s.media_id = f.media_id and s.turn = f.turn and s.pos = f.pos and g >= step group by 1, 2, 3),
aligned as (select w.*, coalesce(speakers, []::varchar[]) as speakers from words w left join chosen c on c.media_id = w.media_id and c.turn = w.turn and c.pos = w.pos)"""

UTTERANCES_SQL = """
changes as (select *, case when speakers is not distinct from lag(speakers) over o and row_number() over o > 1 then 0 else 1 end as new from aligned window o as (partition by media_id order by turn, pos)),
numbered as (select *, sum(new) over (partition by media_id order by turn, pos)::bigint as utt from changes),
utterances as (select media_id, utt, first(speakers) as speakers, arg_min(start_ms, (turn, pos)) as start_ms, arg_max(end_ms, (turn, pos)) as end_ms, string_agg(word, ' ' order by turn, pos) as text from numbered group by 1, 2),
labelled as (select *, case when len(speakers) = 0 then '<Unknown>' else array_to_string(speakers, ' & ') end as speaker from utterances)"""

HEAD = "with " + WORDS_SQL.strip() + "," + SEGMENTS_SQL
ALIGNED = HEAD + "," + ALIGNED_SQL
UTTERED = ALIGNED + "," + UTTERANCES_SQL


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, pos, heading, content: documents as chapters of books by source, with headings of nine kinds."""
    d = table(spark, sf_dir, "documents")
    pos = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("pos")
    heading = F.expr(
        "case doc_id % 9 when 0 then concat('Chapter ', doc_id) when 1 then 'Prologue' when 2 then cast(doc_id as string) when 3 then 'Foo' when 4 then concat('x', doc_id % 40) when 5 then 'foo' when 6 then concat('KAPITEL ', doc_id) when 7 then concat('Part ', doc_id) else concat('chapter ', doc_id, ': x') end"
    ).alias("heading")
    return d.select("doc_id", F.col("source").alias("book_id"), pos, heading, "text")


CHAPTERS_SQL = """
chapters as (select doc_id, source as book_id, row_number() over (partition by source order by doc_id)::int as pos, text,
  case doc_id % 9 when 0 then 'Chapter ' || doc_id when 1 then 'Prologue' when 2 then doc_id::varchar when 3 then 'Foo' when 4 then 'x' || (doc_id % 40) when 5 then 'foo' when 6 then 'KAPITEL ' || doc_id when 7 then 'Part ' || doc_id else 'chapter ' || doc_id || ': x' end as heading from documents)"""

VALID_SQL = """
counts as (select book_id, heading, count(*) as n from chapters group by 1, 2),
checked as (select c.book_id, c.heading, regexp_full_match(c.heading, '\\p{N}+') or c.n > 1 or coalesce(l.n, 0) > 1 or lower(c.heading) in ('prologue', 'introduction', 'epilogue', 'prolog', 'epilog') or regexp_full_match(lower(c.heading), '(chapter|kapitel) \\p{Nd}+') as valid from counts c left join counts l on l.book_id = c.book_id and l.heading = lower(c.heading)),
marked as (select chapters.*, valid from chapters join checked using (book_id, heading))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (host), item_no, name (path), html of pages."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    name = F.regexp_extract("url", r"^https?://[^/]+/?(.*)$", 1)
    return p.select("page_id", host.alias("book_id"), name.alias("name"), "html")


def navigation(item_table: DataFrame) -> DataFrame:
    """book_id and nav: a document that names a book's items with an even id, last id first."""
    named = item_table.where("page_id % 2 = 0").groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "name")), asc=False), lambda x: x["name"]).alias("n"))
    return named.select("book_id", F.concat_ws(" ", F.transform("n", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("nav"))


ITEMS_SQL = r"""
items as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as book_id, regexp_extract(url, '^https?://[^/]+/?(.*)$', 1) as name, html from pages),
nav as (select book_id, string_agg('<' || name || '>', ' ' order by page_id desc) as nav from items where page_id % 2 = 0 group by 1)"""


def decoded(x: str) -> str:
    """SQL for text of a piece of HTML."""
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{c}')"
    return out


CLEAN_SQL = r"regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
HEADINGS_SQL = rf"list_transform(regexp_extract_all({CLEAN_SQL}, '(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>', 1), lambda x: {decoded('x')})"
PARAGRAPHS_SQL = rf"list_transform(list_filter(string_split(regexp_replace({CLEAN_SQL}, '(?i)(</?(?:p|div|article|section|aside|main|nav|footer|header|ul|ol|table|h[1-6]|body|html)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1)), lambda x: lower(x[1:3]) in ('<p>', '<p ')), lambda x: {decoded('x')})"
TOKENS_SQL = r"regexp_extract_all({}, '\p{{L}}+')"
SENTENCES_SQL = r"list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
