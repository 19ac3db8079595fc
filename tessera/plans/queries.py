"""Queries over the general tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import overlap_fraction, roman
from tessera.operators import chapters as ch
from tessera.operators import identity, intervals, text, transcript
from tessera.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.words(spark, sf_dir)
    return intervals.align(w, fx.segments(spark, sf_dir, w))


@query(fx.HEAD + f" select w.media_id, w.turn, w.pos, s.turn as seg_turn, s.speaker, round({fx.FRACTION_SQL}, 9) as fraction from words w join segments s on s.media_id = w.media_id and s.from_ms <= w.end_ms and s.to_ms >= w.start_ms")
def word_overlap_fraction(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    s = fx.segments(spark, sf_dir, w).select(F.col("media_id").alias("m"), F.col("turn").alias("seg_turn"), "speaker", "from_ms", "to_ms")
    met = w.join(s, (F.col("media_id") == F.col("m")) & (F.col("from_ms") <= F.col("end_ms")) & (F.col("to_ms") >= F.col("start_ms")))
    return met.select("media_id", "turn", "pos", "seg_turn", "speaker", F.round(overlap_fraction("start_ms", "end_ms", "from_ms", "to_ms"), 9).alias("fraction"))


@query(fx.ALIGNED + " select media_id, turn, pos, word, start_ms, end_ms, speakers from aligned")
def speaker_alignment(spark, sf_dir):
    return aligned(spark, sf_dir).select("media_id", "turn", "pos", "word", "start_ms", "end_ms", "speakers")


@query(fx.UTTERED + " select media_id, utt, speaker, start_ms, end_ms, text from labelled")
def utterances(spark, sf_dir):
    return transcript.with_label(transcript.squish(aligned(spark, sf_dir))).select("media_id", "utt", "speaker", "start_ms", "end_ms", "text")


LINES = fx.UTTERED + ", lines as (select media_id, utt, speaker || ' [' || printf('%.3f', start_ms / 1000.0) || ' - ' || printf('%.3f', end_ms / 1000.0) || ']: ' || text as line from labelled)"


@query(LINES + " select media_id, utt, line from lines")
def transcript_lines(spark, sf_dir):
    return transcript.lines(transcript.squish(aligned(spark, sf_dir)))


@query(LINES + " select media_id, string_agg(line, chr(10) order by utt) as transcript from lines group by 1")
def full_transcript(spark, sf_dir):
    return transcript.full(transcript_lines(spark, sf_dir))


BROKEN = "with " + fx.WORDS_SQL.strip() + ", fin as (select media_id, 0::bigint as init, max(end_ms) as fin from words group by 1), b as (select media_id, row_number() over (partition by media_id order by turn, pos)::int as rn, word, case when (media_id * 5 + turn * 3 + pos * 7) % 11 >= 4 then start_ms end as start_ms, case when (media_id * 3 + turn * 5 + pos * 13) % 9 >= 4 then end_ms end as end_ms from words)"


@query(
    BROKEN
    + """, m as (select *, lag(end_ms) over o as before, lead(start_ms) over o as after, lead(rn) over o as more, case when rn = 1 or not (start_ms is null and lag(end_ms) over o is null) then 1 else 0 end as head from b window o as (partition by media_id order by rn)),
g as (select *, sum(head) over (partition by media_id order by rn) as grp from m),
a as (select media_id, min(rn) as rn, count(*) as n, string_agg(word, ' ' order by rn) as word, arg_min_null(start_ms, rn) as s, arg_min_null(before, rn) as before, arg_max_null(end_ms, rn) as e, arg_max_null(after, rn) as after, arg_max_null(more, rn) as more from g group by media_id, grp)
select media_id, rn, word, coalesce(s, before, init, 0)::bigint as start_ms, coalesce(e, after, case when more is null then case when n = 1 then coalesce(s, before, init, 0) else fin end end)::bigint as end_ms from a join fin using (media_id)"""
)
def repair_word_times(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    broken = w.select(
        "media_id",
        F.row_number().over(W.partitionBy("media_id").orderBy("turn", "pos")).alias("rn"),
        "word",
        F.expr("case when (media_id * 5 + turn * 3 + pos * 7) % 11 >= 4 then start_ms end").alias("start_ms"),
        F.expr("case when (media_id * 3 + turn * 5 + pos * 13) % 9 >= 4 then end_ms end").alias("end_ms"),
    )
    bounds = w.groupBy("media_id").agg(F.lit(0).cast("long").alias("init"), F.max("end_ms").alias("fin"))
    return transcript.repair(broken, bounds)


@query(
    """with s as (select user_id % 7 as media_id, 's' || (user_id % 5) as speaker, epoch_us(ts) as f, (epoch_us(ts) + round(value * 1000) * 1000)::bigint as t from events),
e as (select media_id, speaker, moment, sum(d) as d from (select media_id, speaker, f as moment, 1 as d from s union all select media_id, speaker, t, -1 from s) group by 1, 2, 3),
o as (select *, sum(d) over (partition by media_id, speaker order by moment) as open, lead(moment) over (partition by media_id, speaker order by moment) as until from e),
times as (select media_id, moment, lead(moment) over (partition by media_id order by moment) as next_moment from (select distinct media_id, moment from e))
select t.media_id, t.moment, t.next_moment, coalesce(sum(open), 0)::bigint as active, coalesce(list_sort(list(distinct speaker) filter (speaker is not null)), []) as speakers from times t left join o on o.media_id = t.media_id and o.open > 0 and o.moment <= t.moment and t.moment < o.until group by 1, 2, 3"""
)
def active_speaker_timeline(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = e.select((F.col("user_id") % 7).alias("media_id"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("speaker"), us.alias("from_ms"), (us + (F.round(F.col("value") * 1000) * 1000).cast("long")).alias("to_ms"))
    return intervals.timeline(s)


@query(fx.HEAD + " select media_id, turn, speaker, turn::int as chunk_no, from_ms + turn::int * 300000 as from_ms, to_ms + turn::int * 300000 as to_ms from segments")
def chunk_rebase(spark, sf_dir):
    return intervals.rebase(fx.segments(spark, sf_dir).withColumn("chunk_no", F.col("turn").cast("int")), 300_000)


@query("with " + fx.WORDS_SQL.strip() + ", d as (select media_id, max(end_ms) as duration_ms from words group by 1), c as (select media_id, duration_ms, unnest(range(0, greatest(ceil(duration_ms / 10000.0)::bigint, 1)))::int as chunk_no from d) select media_id, chunk_no, chunk_no::bigint * 10000 as from_ms, least((chunk_no::bigint + 1) * 10000, duration_ms) as to_ms from c")
def media_chunks(spark, sf_dir):
    return intervals.chunks(fx.words(spark, sf_dir).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms")), 10_000)


@query(fx.HEAD + " select media_id, turn, speaker, printf('%.3f', from_ms / 1000.0)::double as from_s, printf('%.3f', to_ms / 1000.0)::double as to_s from segments")
def parse_segments(spark, sf_dir):
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    return intervals.parse(fx.segments(spark, sf_dir).select("media_id", "turn", F.concat_ws(" ", sec("from_ms"), sec("to_ms"), "speaker").alias("line")))


@query(fx.HEAD + " select media_id, speaker, list(from_ms || '-' || to_ms order by from_ms, to_ms) as spans from segments group by 1, 2")
def diarization_map(spark, sf_dir):
    s = fx.segments(spark, sf_dir).groupBy("media_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("from_ms", "to_ms"))).alias("s"))
    return s.select("media_id", "speaker", F.transform("s", lambda x: F.concat_ws("-", x.from_ms, x.to_ms)).alias("spans"))


@query(fx.HEAD + " select media_id, row_number() over (partition by media_id order by from_ms, to_ms, speaker)::int as line_no, 'SPEAKER media_' || media_id || ' 1 ' || printf('%.3f', from_ms / 1000.0) || ' ' || printf('%.3f', (to_ms - from_ms) / 1000.0) || ' <NA> <NA> ' || speaker || ' <NA> <NA>' as line from segments")
def rttm_lines(spark, sf_dir):
    from tessera.sources.sinks import rttm

    return rttm(fx.segments(spark, sf_dir).withColumn("file", F.concat(F.lit("media_"), "media_id")))


@query(fx.HEAD + " select media_id, turn, case when speaker in ('user', 'assistant') and media_id % 3 = 0 then 'Ann' else speaker end as speaker, from_ms, to_ms from segments")
def relabel_segments(spark, sf_dir):
    s = fx.segments(spark, sf_dir)
    names = s.where("speaker in ('user', 'assistant') and media_id % 3 = 0").select("media_id", "speaker").distinct().withColumn("name", F.lit("Ann"))
    return identity.relabel(s, names).select("media_id", "turn", "speaker", "from_ms", "to_ms")


@query(
    "with "
    + fx.WORDS_SQL.strip()
    + ", v as (select media_id, sum(end_ms - start_ms) filter (turn % 2 = 0) as v from words group by 1), m as (select media_id, max(end_ms) as d, max(length(word)) as peak, sum(length(word) * length(word)) as sq, count(*) as n from words group by 1) select media_id, 'media_' || media_id || '.wav' as file_name, round(d / 1000.0, 3) as duration, round(coalesce(v, d) / 1000.0, 3) as duration_after_vad, 16000::int as sample_rate, round(20 * log10(peak / 64.0), 6) as max_dbfs, floor(sqrt(sq / n))::int as rms, case when media_id % 4 = 0 then '' else 'en' end as language from m join v using (media_id)"
)
def media_info(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    m = w.groupBy("media_id").agg(F.max("end_ms").alias("d"), F.sum(F.when(F.col("turn") % 2 == 0, F.col("end_ms") - F.col("start_ms"))).alias("v"), F.max(F.length("word")).alias("peak"), F.sum(F.length("word") * F.length("word")).alias("sq"), F.count(F.lit(1)).alias("n"))
    language = F.when(F.col("media_id") % 4 != 0, F.lit("en"))
    return m.select(
        "media_id",
        F.concat(F.lit("media_"), "media_id", F.lit(".wav")).alias("file_name"),
        F.round(F.col("d") / 1000.0, 3).alias("duration"),
        F.round(F.coalesce("v", "d") / 1000.0, 3).alias("duration_after_vad"),
        F.lit(16000).alias("sample_rate"),
        F.round(20 * F.log10(F.col("peak") / 64.0), 6).alias("max_dbfs"),
        F.floor(F.sqrt(F.col("sq") / F.col("n"))).cast("int").alias("rms"),
        F.coalesce(language, F.lit("")).alias("language"),
    )


GOLD = "with gold as (select label::varchar as name, min(vec_id) as ord, arg_min(embedding, vec_id) as g from embeddings group by 1)"


def gold(spark, sf_dir):
    return identity.gold_first(fx.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string")), "label", "vec_id")


@query(GOLD + " select name, ord from gold")
def gold_exemplars(spark, sf_dir):
    return gold(spark, sf_dir).select("name", "ord")


@query(GOLD + ", s as (select vec_id as id, name, ord, list_cosine_similarity(embedding::double[], g::double[]) as sim from embeddings, gold), r as (select *, row_number() over (partition by id order by sim desc, ord) as k from s) select id, case when sim > 0.3 then name end as name, round(sim, 4) as similarity from r where k = 1")
def identify_speaker(spark, sf_dir):
    voices = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return identity.identify(voices, gold(spark, sf_dir)).select("id", "name", F.round("similarity", 4).alias("similarity"))


@query()
def chunk_identity_fold(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    chunked = e.select((F.col("vec_id") % 4).alias("media_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("chunk_no"), F.format_string("local_%03d", F.col("vec_id") % 50).alias("speaker"), "embedding", F.lit(1.0).alias("weight"))
    return identity.carry(chunked)


@query("select doc_id as id, '/data/' || source || '/' || doc_id || '.txt' as path, source as folder, doc_id || '.txt' as name, doc_id::varchar as stem, row_number() over (order by doc_id || '.txt', '/data/' || source || '/' || doc_id || '.txt')::int as place from documents")
def file_registry(spark, sf_dir):
    from tessera.sources.files import registered

    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return registered(d.union(d.where("id % 2 = 0"))).select("id", "path", F.element_at(F.split("path", "/"), -2).alias("folder"), "name", "stem", "place")


@query("select doc_id as id, 'doc_' || doc_id || '.txt' as name, 'doc_' || doc_id as stem, sha1(text) as sha1, strlen(text)::bigint as bytes from documents")
def file_meta(spark, sf_dir):
    from tessera.sources.files import meta

    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/data/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return meta(d).select("id", "name", "stem", "sha1", "bytes")


@query("with f as (select page_id as id, case page_id % 4 when 0 then 'x.html' when 1 then 'x.epub' when 2 then 'x.bin' else 'x.wav' end as path, case page_id % 4 when 1 then 'PK' else '' end || case page_id % 4 when 3 then 'RIFF0000WAVE' else '' end || html as h from pages) select id, unnest(case when k = [] then ['unrecognized'] else k end) as pipeline from (select id, list_filter([case when h[:4] = 'RIFF' and h[9:12] = 'WAVE' then 'podcast' end, case when h[:2] = 'PK' and path like '%.epub' then 'book' end, case when lower(ltrim(h, ' ' || chr(10))[:14]) = '<!doctype html' then 'page' end], lambda x: x is not null) as k from f)")
def route_by_type(spark, sf_dir):
    from tessera.sources.files import routed

    p = fx.table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, "x.html").when(kind == 1, "x.epub").when(kind == 2, "x.bin").otherwise("x.wav")
    front = F.when(kind == 1, "PK").when(kind == 3, "RIFF0000WAVE").otherwise("")
    return routed(p.select(F.col("page_id").alias("id"), path.alias("path"), F.encode(F.concat(front, "html"), "utf-8").alias("content"))).select("id", "pipeline")


@query(f"select page_id, unnest({fx.HEADINGS_SQL}) as heading from pages")
def html_headings(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.explode(ch.headings(F.col("html"))).alias("heading"))


@query(f"select page_id, (generate_subscripts(p, 1) - 1)::int as no, unnest(p) as paragraph from (select page_id, {fx.PARAGRAPHS_SQL} as p from pages)")
def html_paragraphs(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(ch.paragraphs(F.col("html"))).alias("no", "paragraph"))


@query("with " + fx.ITEMS_SQL.strip() + rf" select page_id, book_id, name, regexp_replace(h[1], '^\s+|\s+$', '', 'g') as heading from (select *, {fx.HEADINGS_SQL} as h from items) where len(h) = 1 and length(h[1]) > 0")
def single_heading_pages(spark, sf_dir):
    return ch.single_heading(fx.items(spark, sf_dir)).select("page_id", "book_id", "name", "heading")


@query("with " + fx.ITEMS_SQL.strip() + " select page_id, items.book_id, name, instr(nav, name)::int as place, row_number() over (partition by items.book_id order by instr(nav, name), page_id)::int as pos from items join nav using (book_id) where instr(nav, name) > 0")
def nav_order(spark, sf_dir):
    i = fx.items(spark, sf_dir)
    found = ch.in_navigation(i, fx.navigation(i))
    return found.select("page_id", "book_id", "name", "place", F.row_number().over(W.partitionBy("book_id").orderBy("place", "page_id")).alias("pos"))


MARKED = "with " + fx.CHAPTERS_SQL.strip() + "," + fx.VALID_SQL


@query(MARKED + " select doc_id, book_id, pos, heading, valid from marked")
def chapter_valid(spark, sf_dir):
    return ch.valid(fx.chapters(spark, sf_dir).drop("text")).select("doc_id", "book_id", "pos", "heading", "valid")


@query(MARKED + " select distinct book_id, heading from marked where not valid")
def chapter_invalid(spark, sf_dir):
    c = fx.chapters(spark, sf_dir).drop("text")
    return c.select("book_id", "heading").distinct().join(ch.valid(c).where("valid").select("book_id", "heading").distinct(), ["book_id", "heading"], "left_anti")


ROMAN_SQL = "['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][1 + k // 100 % 10] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][1 + k // 10 % 10] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][1 + k % 10]"
ROMAN_SQL = "['', 'M', 'MM', 'MMM'][1 + k // 1000] || " + ROMAN_SQL
PRETTY = MARKED + f", n as (select *, count(*) over (partition by book_id, heading) as n, row_number() over (partition by book_id, heading order by pos) as k from marked where valid), pretty as (select *, case when n > 1 then heading || ' ' || {ROMAN_SQL} end as heading_beautified from n)"


@query(PRETTY + " select doc_id, book_id, pos, heading, heading_beautified, coalesce(heading_beautified, heading) as shown from pretty")
def chapter_beautify(spark, sf_dir):
    return ch.beautify(ch.valid(fx.chapters(spark, sf_dir).drop("text")).where("valid")).select("doc_id", "book_id", "pos", "heading", "heading_beautified", "shown")


@query(f"select k::int as n, {ROMAN_SQL} as numeral from range(1, 4000) r(k)")
def roman_numerals(spark, sf_dir):
    return spark.range(1, 4000).select(F.col("id").cast("int").alias("n"), roman("id").alias("numeral"))


VOTES = {k: f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in v)})))" for k, v in text.STOPWORDS.items()}
TOP = "greatest(" + ", ".join(VOTES) + ")"


@query(f"with t as (select doc_id, {fx.TOKENS_SQL.format('lower(text)')} as w from documents), v as (select doc_id, {', '.join(f'{s} as {k}' for k, s in VOTES.items())} from t) select doc_id, case when {TOP} = 0 then null " + " ".join(f"when {k} = {TOP} then '{k}'" for k in VOTES) + " end as language from v")
def language_detect(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


SENTS = f"with s as (select doc_id, (generate_subscripts(l, 1) - 1)::int as sent_no, unnest(l) as sentence from (select doc_id, {fx.SENTENCES_SQL} as l from documents))"


@query(SENTS + " select doc_id, sent_no, sentence from s")
def sentence_split(spark, sf_dir):
    return text.sentence_table(fx.table(spark, sf_dir, "documents"), ["doc_id"])


STOPS = ", ".join(sorted({repr(w) for v in text.STOPWORDS.values() for w in v}))
LEMMAS = SENTS + f", l as (select doc_id, sent_no, unnest({fx.TOKENS_SQL.format('lower(sentence)')}) as lemma from s), c as (select doc_id, sent_no, lemma, count(*) as n from l where lemma not in ({STOPS}) group by 1, 2, 3)"


@query(LEMMAS + " select doc_id, sent_no, lemma, n from c")
def sentence_words(spark, sf_dir):
    return text.document_words(fx.table(spark, sf_dir, "documents"), ["doc_id"])


@query(LEMMAS + " select source as book_id, lemma, sum(n)::bigint as n from c join documents using (doc_id) group by 1, 2")
def chapter_words(spark, sf_dir):
    return text.total_words(fx.table(spark, sf_dir, "documents").withColumnRenamed("source", "book_id"), ["book_id"])


ENT = (
    SENTS
    + ", e as ("
    + " union all ".join(
        f"select doc_id, sent_no, '{k}' as label, unnest(regexp_extract_all(sentence, '{p}')) as ent, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(replace(x, chr(2), ''))))::int)) as \"from\" from (select *, string_split(regexp_replace(sentence, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as parts from s where regexp_matches(sentence, '{p}'))"
        for k, p in text.ENTITIES.items()
    )
    + "), f as (select *, (\"from\" + length(ent))::int as \"to\" from e)"
)


@query(ENT + ' select doc_id, sent_no, label, ent, "from", "to" from f')
def entities(spark, sf_dir):
    return text.entities(sentence_split(spark, sf_dir), ["doc_id"])


@query(ENT + ", k as (select doc_id, label, list(sent_no || ':' || \"from\" || ':' || ent order by sent_no, \"from\") as spans from f group by 1, 2) select doc_id, l.label, coalesce(spans, []) as spans from documents cross join (select unnest(['DATE_', 'EMAIL', 'NUMBER', 'URL', 'PHONE']) as label) l left join k using (doc_id, label)")
def entity_label_map(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*(F.lit(x) for x in ("DATE_", *text.ENTITIES)))).alias("label"))
    e = entities(spark, sf_dir).groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(F.struct("sent_no", "from", "ent"))).alias("s"))
    return d.join(e, ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce(F.transform("s", lambda x: F.concat_ws(":", x["sent_no"], x["from"], x["ent"])), F.array().cast("array<string>")).alias("spans"))


CHUNKS = r"with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, (unnest(range(0, greatest(len(w) - 1 - 10, 0) // 50 + 1)))::int as chunk_no, w from w where len(w) > 0), k as (select doc_id, chunk_no, array_to_string(w[chunk_no * 50 + 1 : chunk_no * 50 + 60], ' ') as chunk from c)"


@query(CHUNKS + " select doc_id, chunk_no, chunk from k")
def chunk_text(spark, sf_dir):
    return text.word_windows(fx.table(spark, sf_dir, "documents"), "doc_id", 60, 50)


@query()
def chunk_text_recursive(spark, sf_dir):
    return text.chunk_recursive(fx.table(spark, sf_dir, "documents"), "doc_id", 1500, 200)


@query(CHUNKS + " select doc_id, string_agg(chunk[:20], '' order by chunk_no) as summary from k group by 1")
def refine_fold(spark, sf_dir):
    return text.refine(chunk_text(spark, sf_dir), "doc_id")


@query(PRETTY + """, j as (select book_id, pos, '{"heading_raw":"' || heading || '","heading":"' || coalesce(heading_beautified, heading) || '","lines":' || len(string_split(text, chr(10))) || '}' as c from pretty) select book_id, '{"title":"' || book_id || '","chapters":[' || string_agg(c, ',' order by pos) || ']}' as book from j group by 1""")
def book_json_rollup(spark, sf_dir):
    from tessera.sources.sinks import book_json

    c = fx.chapters(spark, sf_dir)
    pretty = ch.beautify(ch.valid(c).where("valid"))
    parts = pretty.select("book_id", "pos", F.col("heading").alias("heading_raw"), F.col("shown").alias("heading"), F.size(F.split("text", "\n")).alias("lines"))
    return book_json(parts, F.col("book_id"))


@query("select event_id as id, k, case when k is null then 'no number' end as error from (select event_id, try_cast(json_extract_string(case when event_id % 10 = 0 then '{}' else props end, '$.k') as int) as k from events)")
def error_quarantine(spark, sf_dir):
    from tessera.sources.sinks import guarded

    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 0, "{}").otherwise(F.col("props")).alias("props"))
    return guarded(e, F.get_json_object("props", "$.k").try_cast("int"), "k", "no number").select("id", "k", "error")
