"""Per-document operators against brute-force versions, with nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import base64
import math
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, common, fingerprints, html, packing, sharding, toxicity, wordpiece

LONG = "Längere Wörter, and more words. " * 20_000
TEXTS = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (4, LONG), (1, "Hello world, it's 42!"), (None, "no id"), (5, " \n\t "), (6, "ééé 中文 🙂🙂 a_b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 7, [1]) for r in TEXTS], "doc_id long, text string, slot string, tokens int, sketch array<int>")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# fingerprints


def word_hash(w):
    h = 0
    for k, b in enumerate(w.encode()):
        h += (b + 1) * pow(common.BASE, k, 1 << 64)
    return int(common.mix(np.array([h % (1 << 64)], np.uint64))[0])


def gram_hash(words, n):
    out = 0
    for k in range(n):
        out = out * common.BASE + (word_hash(words[k]) if k < len(words) else 0) + k + 1
    return int(common.mix(np.array([out % (1 << 64)], np.uint64))[0])


def shingles(text, n):
    w = re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", (text or "").lower())
    return {gram_hash(w[k : k + n], n) for k in range(max(1, len(w) - n + 1))} if w else set()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_sketches_against_brute_force(docs, real, none):
    got = sorted(((r.doc_id, r.shingles, tuple(r.sketch)) for r in fingerprints.sketches(docs).collect()), key=str)
    want = sorted(((i, len(s), tuple(signed(x) for x in sorted(s) if x < (1 << 64) // fingerprints.SCALED)) for i, t in TEXTS for s in [shingles(t, fingerprints.SHINGLE)]), key=str)
    assert got == want
    some = real.where("n_chars < 3000").select("doc_id", "text").collect()[:25]
    by_id = {r.doc_id: r for r in fingerprints.sketches(real).collect()}
    for r in some:
        s = shingles(r.text, fingerprints.SHINGLE)
        assert by_id[r.doc_id].shingles == len(s)
        assert set(by_id[r.doc_id].sketch) == {signed(x) for x in s if x < (1 << 64) // fingerprints.SCALED}
    assert fingerprints.sketches(none).collect() == []


def test_containment_of_a_short_text_in_a_long_one(spark):
    long = [f"w{k}" for k in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[100:2100])), (3, " ".join(long[100:1100] + [f"v{k}" for k in range(1000)]))]
    s = {r.doc_id: r.sketch for r in fingerprints.sketches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    df = spark.createDataFrame([(s[2], s[1], s[3])], "a array<long>, b array<long>, c array<long>")
    r = df.select(fingerprints.containment(df.a, df.b).alias("x"), fingerprints.containment(df.c, df.b).alias("y"), fingerprints.resemblance(df.a, df.a).alias("z")).first()
    assert r.x == 1.0 and abs(r.y - 0.5) < 0.15 and r.z == 1.0
    both = spark.createDataFrame([(0, s[2]), (0, s[3])], "g int, sketch array<long>")
    assert fingerprints.merged(both, "g").first().sketch == sorted(set(s[2]) | set(s[3]))


# token counts


def longest_match(word, first, inner):
    at = n = 0
    while at < len(word):
        pieces = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


vocab = st.frozensets(st.text(alphabet="abc", min_size=1, max_size=4), max_size=10)


@settings(max_examples=300, deadline=None)
@given(vocab, vocab, st.lists(st.text(alphabet="abcd", min_size=1, max_size=14), max_size=10))
def test_automaton_is_greedy_longest_match(first, inner, words):
    a = wordpiece.Automaton(first, inner)
    assert [a.count(w) for w in words] == [longest_match(w, first, inner) for w in words]


def test_token_counts_against_brute_force(docs, real, none):
    first, inner = wordpiece.vocabulary()

    def brute(t):
        w = wordpiece.WORD.findall((t or "").lower())
        return len(w), sum(longest_match(x, first, inner) for x in w)

    got = sorted(map(tuple, wordpiece.token_counts(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in TEXTS), key=str)
    by_id = {r.doc_id: (r.words, r.tokens) for r in wordpiece.token_counts(real).collect()}
    for r in real.limit(40).collect():
        assert by_id[r.doc_id] == brute(r.text)
    assert wordpiece.token_counts(none).collect() == []


def test_full_store_of_counts(monkeypatch):
    monkeypatch.setattr(wordpiece, "REMEMBERED", 2)
    c = wordpiece.Counts(wordpiece.Automaton({"a"}, {"a"}))
    assert [c["a" * k] for k in (1, 2, 3, 100, 2)] == [1, 2, 3, 100, 2]


# BPE


@pytest.fixture(scope="module")
def usual():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab ", max_size=60), st.text(alphabet="the in\n'", max_size=60)), max_size=6))
def test_codec_against_the_usual_encoder(usual, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    c = bpe.codec()
    for t, p in zip(texts, c.encode(texts)):
        tokens = np.frombuffer(p, np.int32)
        assert tokens.tolist() == usual.encode_ordinary(t)
        assert c.decode(tokens).decode() == t


def test_encoded_table(docs, real, none, usual):
    rows = bpe.encoded(docs).collect()
    assert sorted(((r.doc_id, r.tokens, r.n_tokens, r.round_trip) for r in rows), key=str) == sorted(((i, *((usual.encode_ordinary(t), len(usual.encode_ordinary(t)), True) if t is not None else (None, None, None))) for i, t in TEXTS), key=str)
    out = bpe.encoded(real)
    assert out.where("not round_trip").count() == 0
    texts = {r.doc_id: r.text for r in real.collect()}
    assert all(r.tokens == usual.encode_ordinary(texts[r.doc_id]) for r in out.collect())
    assert {r.doc_id: r.text for r in bpe.decoded(out).collect()} == texts
    assert bpe.encoded(none).collect() == []


def test_full_store_of_words(monkeypatch, usual):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec()
    for t in ("one two three four", "five six one", "two one seven"):
        assert np.frombuffer(c.encode([t])[0], np.int32).tolist() == usual.encode_ordinary(t)


# html


def test_layout():
    assert html.extract("<ul><li>a<li>b<ol start=3><li>x<p>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n     y\n- c"
    assert html.extract("<table><tr><th>Name<th>N<tr><td>a<td>10<tr><td colspan=2>long one<td>z</table>") == "Name  N\na     10\nlong one  z"
    assert html.extract("<p>one<p>two<div>three</div>four<br>five") == "one\n\ntwo\n\nthree\nfour\nfive"
    assert html.extract("<pre>  x\n   y</pre>z &amp; &eacute;") == "  x\n   y\n\nz & é"
    assert html.extract("<ol reversed><li>a<li>b<li value=9>c</ol>") == "3. a\n2. b\n9. c"
    assert html.extract("a<h1>T<h2>U</h2>b") == "a\n\nT\n\nU\n\nb"


def test_visibility():
    page = "<html><head><title>no</title><style>p{}</style></head><body><script>var t='</p>no'</script><p>yes<!-- no --><span hidden>no</span><div style='display: none'>no</div><div style='visibility:hidden'>no<b style='visibility:visible'>seen</b></div><details><summary>sum</summary>no</details><dialog>no</dialog><input type=hidden value=no><noscript>no</noscript><template>no</template><img alt=pic></body></html>"
    assert html.extract(page) == "yes\n\nseen\nsum\npic"


def test_hostile_pages():
    assert html.extract(None) is None and html.extract("") == "" and html.extract("<script>x") == ""
    assert html.extract("a < b & c <d") == "a < b & c <d"
    assert html.extract("</p></div>x</b>") == "x"
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.extract("<a title='x > y' href=\"</p>\">t</a>") == "t"
    assert html.extract("<table><tr><td><ul><li>a<li>b</ul><td><table><tr><td>c</table></table>") == "- a - b  c"


class Words(HTMLParser):
    """Words of a page by the standard parser, without the hidden elements that the test pages have."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_pages_have_all_their_words(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for r in pages.collect():
        p = Words()
        p.feed(r.html)
        p.close()
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in p.words if w != "-"]
    odd = spark.createDataFrame([(1, None, 5), (None, "<p>x", 5), (1, None, 5)], "page_id long, html string, text int")
    assert sorted(map(tuple, html.extracted(odd).collect()), key=str) == [(1, None), (1, None), (None, "x")]


# toxicity


GRAMMAR = toxicity.Grammar({w: toxicity.W_INSULT for w in toxicity.INSULTS} | {"weak": 0.4})


def back(kinds, k, over):
    """Place of the nearest word before k that isn't of these kinds, or -1."""
    k -= 1
    while k >= 0 and kinds[k] in over:
        k -= 1
    return k


def threatens(kinds, k):
    """Whether an English threat ends at the word k."""
    x = toxicity
    verb = back(kinds, k, (x.DEGREE,))
    if kinds[k] not in (x.TARGET, x.SELF) or verb < 0 or kinds[verb] != x.THREAT:
        return False
    before = back(kinds, verb, (x.DEGREE, x.TARGET, x.SELF))
    if before >= 0 and kinds[before] == x.INTENT:
        return True
    before = back(kinds, verb, (x.DEGREE,))
    return kinds[k] == x.SELF and not (before >= 0 and kinds[before] == x.NEGATION)


def by_rules(text, g=GRAMMAR):
    """The grammar said again as rules over words."""
    scores, learned = [], 0.0
    for clause in toxicity.CLAUSE.split((text or "").lower()):
        score, named, reported = 0.0, False, False
        words = toxicity.WORD.findall(clause)
        kinds = [g.kind.get(w, toxicity.OTHER) for w in words]
        for k, (w, c) in enumerate(zip(words, kinds)):
            before = back(kinds, k, (toxicity.DEGREE,))
            negated = before >= 0 and kinds[before] == toxicity.NEGATION
            scale = (toxicity.KEEP_NEGATED if negated else 1) * (toxicity.KEEP_REPORTED if reported else 1)
            if c == toxicity.INSULT:
                score += (g.weights[w] + toxicity.W_TARGET * named) * scale
                learned += (g.weights[w] + toxicity.W_TARGET * named) * scale * (w in g.learned)
            if threatens(kinds, k):
                score += toxicity.W_THREAT * scale
            named |= c in (toxicity.TARGET, toxicity.SELF)
            reported |= c == toxicity.REPORT
        scores.append(score)
    return round(max(max(scores), learned), 6), sum(s > 0 for s in scores)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("you idiot not a will kill them said weak word . , never the moron must i yourself going to isn t look".split()), max_size=14).map(" ".join))
def test_transducer_is_the_rules(text):
    score, n = GRAMMAR.score(text)
    want, m = by_rules(text)
    assert math.isclose(score, want, abs_tol=1e-5) and n == m


@pytest.mark.parametrize(("text", "toxic"), [("You are an idiot.", True), ("He is not an idiot.", False), ("She said that he is an idiot.", False), ("I will kill you", True), ("They kill time", False), ("a weak word", False), ("", False), (None, False)])
def test_clauses(text, toxic):
    assert (GRAMMAR.score(text)[0] >= toxicity.THRESHOLD) == toxic


def test_every_row_is_scored(docs, none):
    got = sorted(((r.doc_id, r.score, r.clauses, r.toxic) for r in toxicity.score_documents(docs, GRAMMAR).collect()), key=str)
    assert got == sorted(((i, *by_rules(t), by_rules(t)[0] >= 1) for i, t in TEXTS), key=str)
    assert toxicity.score_documents(none, GRAMMAR).collect() == []
    kept = toxicity.keep_clean(docs, GRAMMAR)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def brute_fit(labels, rows):
    """The lexicon of labels that all fit the sample, counted word by word."""
    toxic = {}
    for i, x in labels:
        if i is not None and x is not None:
            toxic[i] = max(x, toxic.get(i, 0))
    said = [(toxic[i], re.findall(r"\w+", t.lower())) for i, t in rows if i in toxic and t is not None]
    bad, good = sum(x for x, _ in said), sum(1 - x for x, _ in said)
    weights = {w: toxicity.W_INSULT for w in toxicity.INSULTS}
    for w in {w for _, words in said for w in words if len(w) >= 3}:
        held = [x for x, words in said if w in words]
        if sum(held) >= 3 and 2 * sum(held) > len(held):
            around = {(x, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "") for x, words in said for k, v in enumerate(words) if v == w}
            k = sum(x for x, *_ in around)
            if found := toxicity.learned(k, len(around) - k, bad, good):
                weights[w] = max(found, weights.get(w, 0.0))
    return weights


def test_fit_learns_from_contexts_and_not_from_copies(spark):
    rng = np.random.default_rng(3)
    usual = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        w = list(rng.choice(usual, 40))
        toxic = k % 8 == 0
        if toxic:
            for at in rng.choice(38, 2, replace=False):
                w[at] = "blargh"
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(1000 + k, "a copied text that was toxic once zork") for k in range(30)] + [(2000, None)]
    labels += [(1000 + k, 1) for k in range(30)] + [(2000, 1), (None, 1), (1, None), (3000, 0)]
    g = toxicity.fit(spark.createDataFrame(labels, "doc_id long, toxic int"), spark.createDataFrame(rows, "doc_id long, text string"))
    assert g.weights == brute_fit(labels, rows)
    assert g.weights["blargh"] >= 1 and "zork" not in g.weights and "copied" not in g.weights
    empty = toxicity.fit(spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "doc_id long, text string"))
    assert set(empty.weights) == set(toxicity.INSULTS)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    g = toxicity.fit(labels.where("doc_id % 2 = 0"), docs)
    held = toxicity.score_documents(docs, g).select("doc_id", toxicity.F.col("toxic").alias("found")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r.toxic, r.found): r["count"] for r in held.groupBy("toxic", "found").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.85
    assert n.get((0, True), 0) / n[0, False] < 0.015


# packing


def brute_pack(sizes, capacity):
    seqs, out = [], []
    for s in sizes:
        fitting = [q for q in range(len(seqs)) if seqs[q][0] + s <= capacity]
        to = min(fitting, key=lambda q: (seqs[q][1], q)) if fitting else len(seqs)
        if to == len(seqs):
            seqs.append([0, 0.0])
        out.append((to, seqs[to][0]))
        seqs[to] = [seqs[to][0] + s, seqs[to][1] + packing.LINEAR * s + packing.QUADRATIC * float(s) ** 2]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40))
def test_pack_against_brute_force(sizes):
    sizes = sorted(sizes, reverse=True)
    seq, start, _ = packing.pack(np.array(sizes, np.int64), 50)
    assert list(zip(seq.tolist(), start.tolist())) == brute_pack(sizes, 50)


def test_packed_table(docs, none):
    rows = packing.packed(docs).collect()
    tokens = {i: len(bpe.codec().encode([t or ""])[0]) // 4 for i, t in TEXTS}
    for i, t in TEXTS:
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == tokens[i] * sum(j == i for j, _ in TEXTS)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence, []).append((r.token_start, r.n_tokens))
    for spans in by_seq.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at or n == 0
            at = start + n
        assert at <= packing.CAPACITY
    order = sorted(rows, key=lambda r: (-r.n_tokens, r.doc_id is not None, r.doc_id or 0, r.piece))
    assert [r.n_tokens for r in order] == sorted((r.n_tokens for r in rows), reverse=True)
    assert packing.packed(none).collect() == []


def test_a_million_pieces():
    sizes = np.sort(np.random.default_rng(1).integers(1, 4097, 1_000_000))[::-1]
    began = time.time()
    seq, start, _ = packing.pack(sizes)
    assert time.time() - began < 60
    assert int(np.bincount(seq, sizes).max()) <= packing.CAPACITY and (start + sizes <= packing.CAPACITY).all()


def test_given_lengths(spark):
    rows = [(1, "x", 5000, 1), (2, "y", None, 2), (3, None, 0, 3), (4, "z", 10, 4), (4, "z", 10, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, g int")
    got = sorted((r.doc_id, r.piece, r.n_tokens) for r in packing.packed(df, tokens=packing.F.coalesce("n", packing.F.lit(0))).collect())
    assert got == [(1, 0, 4096), (1, 1, 904), (2, 0, 0), (3, 0, 0), (4, 0, 10), (4, 0, 10)]


def test_packed_rows_follow_brute_force(spark, monkeypatch, real):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = packing.packed(real).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence.split("-")[0], []).append(r)
    assert len(groups) > 1
    for g in groups.values():
        g.sort(key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        # rows of one size and id differ by piece alone here
        assert sorted((int(r.sequence.split("-")[1]), r.token_start) for r in g) == sorted(brute_pack([r.n_tokens for r in g], packing.CAPACITY))


# sharding


def test_sharding(spark, docs, none, tmp_path):
    rng = np.random.default_rng(0)
    sizes = spark.createDataFrame([(k, int(x)) for k, x in enumerate(rng.integers(0, 10_000, sharding.SLOTS))], "slot int, bytes long")
    one = sharding.first_map(spark)
    sharding.store(one, f"{tmp_path}/map")
    two = sharding.rebalance(sharding.load(spark, f"{tmp_path}/map"), sizes, sharding.GROWN)
    sharding.store(two, f"{tmp_path}/map")
    assert sharding.load(spark, f"{tmp_path}/map").first().version == 2
    assert sharding.load(spark, f"{tmp_path}/map", 1).count() == sharding.SLOTS
    bytes_ = {r.slot: r.bytes for r in sizes.collect()}
    was, now = ({r.slot: r.shard for r in m.collect()} for m in (one, two))
    assert set(now) == set(range(sharding.SLOTS)) and set(now.values()) == set(range(sharding.GROWN))
    load = [sum(bytes_[s] for s in now if now[s] == k) for k in range(sharding.GROWN)]
    assert max(load) <= sum(load) / sharding.GROWN * 1.02
    assert sum(bytes_[s] for s in now if now[s] != was[s]) <= sum(load) * (1 - sharding.SHARDS / sharding.GROWN) * 1.1
    shrunk = {r.slot: r.shard for r in sharding.rebalance(two, sizes, 5).collect()}
    assert set(shrunk) == set(range(sharding.SLOTS)) and set(shrunk.values()) == set(range(5))
    with pytest.raises(Exception, match="exist"):
        sharding.store(one, f"{tmp_path}/map")
    out = sharding.assign(docs, one, two).collect()
    assert sorted((r.bytes for r in out)) == sorted(len((t or "").encode()) for _, t in TEXTS)
    assert len({r.slot for r in out if r.doc_id == 1}) == 1
    counted = sharding.slot_bytes(none)
    assert counted.count() == sharding.SLOTS and counted.agg({"bytes": "sum"}).first()[0] == 0
    assert sharding.rebalance(one, counted, sharding.GROWN).count() == sharding.SLOTS
