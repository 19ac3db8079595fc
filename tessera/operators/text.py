"""Language, sentences, words and entities of texts, and chunks with a fold over them."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by which a language is voted for; ties go to the language listed first.
STOPWORDS = {
    "en": "the and of to in is that it for was with are".split(),
    "de": "der die und das ist nicht ein zu den mit von für".split(),
    "fr": "le la les et des est une que dans qui pour du".split(),
    "es": "el los las que en por una del con se para como".split(),
}
#: Patterns of entities by label.
ENTITIES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "NUMBER": r"[0-9]+",
    "URL": r"https?://[A-Za-z0-9./_-]+",
    "PHONE": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}
#: Rows of keys up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
SEPARATORS = ["\n\n", "\n", ".", ",", " ", "​", "，", "、", "．", "。", ""]


def tokens(text) -> Column:
    """Runs of letters."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), lambda x: x != "")


def _one_of(values: list[str]):
    return lambda x: x.isin(*values)


def language(text) -> Column:
    """Language with the most stop words; null without any."""
    words = tokens(F.lower(text))
    votes = {k: F.size(F.filter(words, _one_of(v))) for k, v in STOPWORDS.items()}
    top = F.greatest(*votes.values())
    out = F.when(top == 0, F.lit(None).cast("string"))
    for k, v in votes.items():
        out = out.when(v == top, F.lit(k))
    return out


def sentences(text) -> Column:
    """Pieces that end in . ! or ? before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def sentence_table(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, sent_no and sentence."""
    return docs.select(*keys, F.posexplode(sentences(F.col(text))).alias("sent_no", "sentence"))


def lemmas(text, stop: list[str] | None = None) -> Column:
    """Lower-case words that aren't stop words."""
    stop = stop or sorted({w for v in STOPWORDS.values() for w in v})
    return F.filter(tokens(F.lower(text)), lambda x: ~x.isin(*stop))


def counted(words) -> Column:
    """Array of (lemma, n) of an array of words. Sorted, a word begins where the one before it differs, so time is as for sorting however long the array."""

    def runs(w):
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        sizes = lambda s: F.transform(s, lambda at, k: F.struct(F.get(w, at).alias("lemma"), (F.coalesce(F.get(s, k + 1), F.size(w)) - at).cast("long").alias("n")))
        return F.transform(F.array(starts), sizes)[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]  # in an array, so that what is sorted is computed once


def sentence_words(sents: DataFrame, keys: list[str], stop: list[str] | None = None, apart: bool = False) -> DataFrame:
    """Lemma (lower-case word) counts per sentence without stop words: keys, sent_no, lemma, n. Rows with the same keys and sent_no
    are one sentence; with apart there are none such, and nothing is shuffled."""
    each = sents.select(*keys, "sent_no", F.inline(counted(lemmas(F.col("sentence"), stop))))
    return each if apart else each.groupBy(*keys, "sent_no", "lemma").agg(F.sum("n").alias("n"))


def document_words(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """sentence_words of a table of texts. Only texts whose keys other rows have too are shuffled, which are looked for first."""
    same = [F.col(k).eqNullSafe(F.col(f"again_{n}")) for n, k in enumerate(keys)]
    again = docs.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"again_{n}") for n, k in enumerate(keys)))
    many = again.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return sentence_words(sentence_table(docs, keys, text), keys, apart=True)
    again = again.hint("broadcast") if many <= BROADCAST_ROWS else again
    once, more = (sentence_table(docs.join(again, same, how), keys, text) for how in ("left_anti", "left_semi"))
    return sentence_words(once, keys, apart=True).union(sentence_words(more, keys))


def total_words(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lemma counts summed over texts: keys, lemma, n. Sentences end at white space, so no word is in two of them, and texts need no splitting."""
    words = docs.select(*keys, F.explode(lemmas(F.col(text))).alias("lemma"))
    return words.groupBy(*keys, "lemma").agg(F.count(F.lit(1)).alias("n"))


def rollup(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Word counts summed over sentences: keys, lemma, n."""
    return counts.groupBy(*keys, "lemma").agg(F.sum("n").alias("n"))


def _spans(label: str, pattern: str) -> Column:
    """Array of (label, ent, from, to) of a pattern's matches in the column sentence."""
    marked = F.split(F.regexp_replace("sentence", pattern, "\u0001$0\u0002"), "\u0001")
    ents = F.transform(F.slice(marked, 2, 10_000_000), lambda x: F.substring_index(x, "\u0002", 1))
    sizes = F.transform(marked, lambda x: F.length(F.replace(x, F.lit("\u0002"), F.lit(""))))
    before = F.transform(ents, lambda x, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, y: s + y))
    spans = F.zip_with(ents, before, lambda x, b: F.struct(F.lit(label).alias("label"), x.alias("ent"), b.alias("from"), (b + F.length(x)).alias("to")))
    return F.when(F.col("sentence").rlike(pattern), spans).otherwise(F.array().cast("array<struct<label:string,ent:string,from:int,to:int>>"))


def entities(sents: DataFrame, keys: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Entities by label: keys, sent_no, label, ent, from, to (offsets in the sentence). One pass over the sentences.

    Offsets come from splitting the sentence at the matches, so they need no search for the entity's text.
    """
    found = [_spans(label, pattern) for label, pattern in (patterns or ENTITIES).items()]
    return sents.select(*keys, "sent_no", F.explode(F.concat(*found)).alias("e")).select(*keys, "sent_no", "e.*")


def word_windows(docs: DataFrame, key: str, size: int, step: int, text: str = "text") -> DataFrame:
    """Chunks of so many words, beginning every step words: key, chunk_no, chunk."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    numbered = docs.select(key, words.alias("w")).where("size(w) > 0").select(key, "w", F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - (size - step), F.lit(0)), F.lit(step))).alias("chunk_no", "at"))
    return numbered.select(key, "chunk_no", F.concat_ws(" ", F.slice("w", F.col("at") + 1, size)).alias("chunk"))


def split_recursive(text: str, size: int, overlap: int, length=len, separators=None) -> list[str]:
    """Chunks of at most size by the first separator that occurs, pieces too long by the next; neighbours share up to overlap.

    The separators stay at the front of the pieces that they begin.
    """
    separators = SEPARATORS if separators is None else separators
    use, rest = "", []
    for k, s in enumerate(separators):
        if s == "" or s in text:
            use, rest = s, separators[k + 1 :]
            break
    if use:
        parts = text.split(use)
        pieces = [p for p in [parts[0], *(use + p for p in parts[1:])] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []

    def merge(parts: list[str]) -> None:
        now: list[str] = []
        total = 0
        for p in parts:
            n = length(p)
            if now and total + n > size:
                out.append("".join(now).strip())
                while now and (total > overlap or total + n > size):
                    total -= length(now.pop(0))
            now.append(p)
            total += n
        if now:
            out.append("".join(now).strip())

    for p in pieces:
        if length(p) <= size:
            held.append(p)
            continue
        if held:
            merge(held)
            held = []
        out.extend(split_recursive(p, size, overlap, length, rest) if rest else [p])
    if held:
        merge(held)
    return [x for x in out if x]


def chunk_recursive(docs: DataFrame, key: str, size: int = 15_000, overlap: int = 200, text: str = "text") -> DataFrame:
    """The recursive splitter over a table: key, chunk_no, chunk. Arrow batches, one pass."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_recursive(t, size, overlap) if t else [])

    return docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk"))


def first_sentence(chunk) -> Column:
    """The default reducer's view of a chunk: its first so many characters."""
    return F.substring(chunk, 1, 20)


def refine(chunk_table: DataFrame, key: str, merge=None) -> DataFrame:
    """key and summary: the chunks of a text folded in order, summary = merge(summary, chunk).

    merge is a column function; by default the head of each chunk is added. Sequential within a text, parallel across texts.
    """
    merge = merge or (lambda s, c: F.concat(s, first_sentence(c)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x.chunk)
    return chunk_table.groupBy(key).agg(ordered.alias("c")).select(key, F.aggregate("c", F.lit(""), merge).alias("summary"))


def refine_with(chunk_table: DataFrame, key: str, step, initial: str = "") -> DataFrame:
    """The fold with a Python function step(summary, chunk) -> summary, such as a language model's call."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        state = initial
        for c in p.sort_values("chunk_no")["chunk"]:
            state = step(state, c)
        return pd.DataFrame({key: [p[key].iloc[0]], "summary": [state]})

    return chunk_table.groupBy(key).applyInPandas(fold, f"{key} {dict(chunk_table.dtypes)[key]}, summary string")


