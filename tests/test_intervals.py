import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import LADDER, UNKNOWN, cosine, overlap_fraction, roman, rung, speaker_label, stem, strip
from tessera.operators import identity, intervals, transcript
from tessera.plans import fixtures as fx

W = "media_id long, turn long, pos int, word string, start_ms long, end_ms long"
S = "media_id long, speaker string, from_ms long, to_ms long"


def fraction(s, e, f, t):
    if s > t or e < f:
        return 0.0
    lo, hi = max(s, f), min(e, t)
    return 0.0 if lo == hi else (hi - lo) / (e - s)


def label(word, segments):
    best = {}
    for sp, f, t in segments:
        best[sp] = max(best.get(sp, 0.0), fraction(*word, f, t))
    for step in LADDER:
        if good := sorted(s for s, g in best.items() if g >= step):
            return good
    return []


def test_ladder_is_repeated_subtraction():
    x, steps = 1.0, []
    while x > 0:
        steps.append(x)
        x -= 0.1
    assert tuple(steps) == LADDER


def test_overlap_cases(spark):
    rows = [(0, 10, 0, 10), (0, 10, 10, 20), (0, 10, 5, 20), (5, 5, 0, 10), (8, 2, 0, 10), (0, 10, 2, 4), (3, 9, 20, 30)]
    df = spark.createDataFrame(rows, "s long, e long, f long, t long").select(overlap_fraction("s", "e", "f", "t").alias("x"))
    assert [r.x for r in df.collect()] == [fraction(*r) for r in rows] == [1.0, 0.0, 0.5, 0.0, 1.0, 0.2, 0.0]


def test_rung(spark):
    got = [r.x for r in spark.createDataFrame([(0.7,), (0.95,), (1.0,), (0.0,), (1e-9,)], "f double").select(rung("f").alias("x")).collect()]
    assert got == [0.6000000000000001, 0.9, 1.0, None, 1.3877787807814457e-16]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60)), min_size=1, max_size=25), st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 300), st.integers(1, 90)), max_size=12), st.sampled_from([7, 50, 1000]))
def test_align_against_brute_force(spark, words, segs, bin_ms):
    segments = [(s, f, f + n) for s, f, n in segs]
    w = spark.createDataFrame([(1, 0, k, f"w{k}", s, s + n) for k, (s, n) in enumerate(words)], W)
    got = {r.pos: r.speakers for r in intervals.align(w, spark.createDataFrame([(1, *s) for s in segments], S), bin_ms).collect()}
    assert got == {k: label((s, s + n), segments) for k, (s, n) in enumerate(words)}


def test_squish_keeps_every_word_and_is_idempotent(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    labelled = intervals.align(w, fx.segments(spark, sf_dir, w))
    assert labelled.count() == w.count()
    u = transcript.squish(labelled).cache()
    words = {r.media_id: r.t for r in w.groupBy("media_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", "word"))), lambda x: x.word)).alias("t")).collect()}
    joined = {r.media_id: r.t for r in u.groupBy("media_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("utt", "text"))), lambda x: x.text)).alias("t")).collect()}
    assert joined == words
    again = transcript.squish(u.select("media_id", F.lit(0).alias("turn"), F.col("utt").alias("pos"), F.col("text").alias("word"), "start_ms", "end_ms", "speakers"))
    assert again.count() == u.count()
    one_shuffle = transcript.squish(spark.createDataFrame([(1, 0, 0, "a", 0, 1, ["x"])], W + ", speakers array<string>"))
    assert one_shuffle._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_squish_order_and_empty_sets(spark):
    rows = [(1, 0, 0, "a", 0, 9, []), (1, 0, 1, "b", 5, 6, []), (1, 0, 2, "c", 6, 7, ["x"]), (1, 1, 0, "d", 3, 4, ["x"]), (1, 1, 1, "e", 8, 9, ["x", "y"])]
    u = transcript.squish(spark.createDataFrame(rows, W + ", speakers array<string>"))
    assert sorted((r.utt, r.start_ms, r.end_ms, r.text, r.speaker) for r in transcript.with_label(u).collect()) == [(1, 0, 6, "a b", UNKNOWN), (2, 6, 4, "c d", "x"), (3, 8, 9, "e", "x & y")]
    assert "x & y [0.008 - 0.009]: e" in [r.line for r in transcript.lines(u).collect()]


REPAIRS = [
    ([(None, None, "a"), (None, None, "b"), (2, 3, "c")], 5, 90, [(5, 2, "a b"), (2, 3, "c")]),
    ([(0, 1, "a"), (None, None, "b"), (None, 2, "c"), (None, None, "d"), (4, 5, "e")], 0, 9, [(0, 1, "a"), (1, 2, "b c"), (2, 4, "d"), (4, 5, "e")]),
    ([(0, 1, "a"), (1, None, "b")], 0, 9, [(0, 1, "a"), (1, 1, "b")]),
    ([(0, 1, "a"), (1, None, "b"), (None, None, "c")], 0, 9, [(0, 1, "a"), (1, 9, "b c")]),
    ([(0, 1, "a"), (None, 3, "b"), (None, None, "c"), (7, 8, "d")], 0, 9, [(0, 1, "a"), (1, 3, "b"), (3, 7, "c"), (7, 8, "d")]),
    ([(None, None, "a")], 5, 9, [(5, 5, "a")]),
]


@pytest.mark.parametrize("case", range(len(REPAIRS)))
def test_repair(spark, case):
    words, init, fin, want = REPAIRS[case]
    w = spark.createDataFrame([(1, k, t, s, e) for k, (s, e, t) in enumerate(words)], "media_id long, rn int, word string, start_ms long, end_ms long")
    out = transcript.repair(w, spark.createDataFrame([(1, init, fin)], "media_id long, init long, fin long"))
    assert [(r.start_ms, r.end_ms, r.word) for r in sorted(out.collect(), key=lambda r: r.rn)] == want


def test_timeline(spark):
    s = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 5, 12), (1, "b", 10, 11)], S)
    got = sorted((r.moment, r.next_moment, r.active, r.speakers) for r in intervals.timeline(s).collect() if r.next_moment)
    assert got == [(0, 5, 1, ["a"]), (5, 10, 2, ["a"]), (10, 11, 2, ["a", "b"]), (11, 12, 1, ["a"])]


def test_timeline_of_long_recordings(spark):
    rng = random.Random(5)
    rows = [(m, rng.choice(["b", "a", "\u00e9", None]), f, f + rng.randrange(-5, 60)) for m in (1, 2, None) for f in (rng.randrange(4000) for _ in range(150))]
    segments = spark.createDataFrame(rows, S)
    want = []
    for m in (1, 2, None):
        moments = sorted({t for r in rows if r[0] == m for t in r[2:]})
        for t, after in zip(moments, [*moments[1:], None]):
            n = {}
            for k, who, f, to in rows:
                if k == m and m is not None:
                    n[who] = n.get(who, 0) + (f <= t) - (to <= t)
            want.append((m, t, after, sum(x for x in n.values() if x > 0), sorted(w for w, x in n.items() if x > 0 and w is not None)))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] or 0, r[1]))
    out = intervals.timeline(segments)
    assert order(map(tuple, out.collect())) == order(want)
    assert dict(out.dtypes) == {"media_id": "bigint", "moment": "bigint", "next_moment": "bigint", "active": "bigint", "speakers": "array<string>"}
    # 40,000 events of one recording: compared with each other they would be 1.6 thousand million pairs
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("media_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("speaker"), (F.col("id") * 7).alias("from_ms"), (F.col("id") * 7 + 30).alias("to_ms"))
    assert "Join" not in intervals.timeline(many)._jdf.queryExecution().toString()
    r = intervals.timeline(many).agg(F.count("*"), F.sum("active"), F.max("next_moment")).first()
    assert tuple(r) == (40_000 - len({k * 7 for k in range(20_000)} & {k * 7 + 30 for k in range(20_000)}), r[1], 19_999 * 7 + 30)


def test_timeline_without_times(spark):
    # open ends come last and close nothing before, as in SQL; a speaker without a later event isn't open
    s = spark.createDataFrame([(1, "a", 5, None), (1, "a", 10, 20), (1, "b", 7, 12)], S)
    got = sorted(map(tuple, intervals.timeline(s).collect()), key=lambda r: (r[1] is None, r[1]))
    assert got == [(1, 5, 7, 1, ["a"]), (1, 7, 10, 2, ["a", "b"]), (1, 10, 12, 3, ["a", "b"]), (1, 12, 20, 2, ["a"]), (1, 20, None, 0, []), (1, None, None, 0, [])]
    assert intervals.timeline(s.limit(0)).collect() == []


def test_chunks_and_parse(spark):
    c = intervals.chunks(spark.createDataFrame([(1, 700), (2, 0)], "media_id long, duration_ms long"), 300).collect()
    assert sorted(map(tuple, c)) == [(1, 0, 0, 300), (1, 1, 300, 600), (1, 2, 600, 700), (2, 0, 0, 0)]
    r = intervals.parse(spark.createDataFrame([("1.50 2.25 speaker_0",)], "line string")).first()
    assert (r.from_s, r.to_s, r.speaker) == (1.5, 2.25, "speaker_0")
    r = intervals.parse(spark.createDataFrame([("broken",)], "line string")).first()
    assert (r.from_s, r.to_s, r.speaker) == (None, None, None)
    moved = intervals.rebase(spark.createDataFrame([(1, "a", 5, 6, 2)], S + ", chunk_no int"), 100).first()
    assert (moved.from_ms, moved.to_ms) == (205, 206)


def test_functions(spark):
    df = spark.createDataFrame([(1994, "/x/a.b.txt", " \n x\t", ["b", None, "a"], [1.0, 0.0], [1.0, 1.0])], "n int, p string, s string, k array<string>, a array<float>, b array<float>")
    r = df.select(roman("n").alias("roman"), stem("p").alias("stem"), strip("s").alias("strip"), speaker_label("k").alias("label"), cosine("a", "b").alias("cos")).first()
    assert (r.roman, r.stem, r.strip, r.label, round(r.cos, 6)) == ("MCMXCIV", "a.b", "x", "<Unknown> & a & b", 0.707107)


def test_identify(spark):
    gold = spark.createDataFrame([("one", 1, [1.0, 0.0]), ("two", 2, [1.0, 0.0]), ("three", 3, None)], "name string, ord long, embedding array<float>")
    voices = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.3, 0.954])], "id long, embedding array<float>")
    got = {r.id: r.name for r in identity.identify(voices, gold).collect()}
    assert got == {1: "one", 2: None, 3: None, 4: None} or got[4] in (None, "one")
    assert got[1] == "one" and got[2] is None and got[3] is None
    none = identity.identify(voices, gold.where("false")).collect()
    assert all(r.name is None for r in none) and len(none) == 4


def test_relabel_merges(spark):
    s = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 2), (1, "c", 2, 3)], S)
    names = spark.createDataFrame([(1, "a", "Ann"), (1, "b", "Ann"), (1, "c", None)], "media_id long, speaker string, name string")
    assert sorted((r.speaker, r.from_ms) for r in identity.relabel(s, names).collect()) == [("Ann", 0), ("Ann", 1), ("c", 2)]
    assert identity.relabel(s, None) is s


def test_carry(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0, "s0", x, 1.0), (1, 0, "s1", y, 1.0), (1, 1, "s0", y, 1.0), (1, 1, "s1", x, 2.0), (1, 7, "s0", x, 1.0), (1, 8, "s0", None, 1.0), (1, 2, "s0", x, 1.0), (1, 2, "s1", x, 1.0)]
    out = identity.carry(spark.createDataFrame(rows, "media_id long, chunk_no int, speaker string, embedding array<float>, weight double"))
    got = {(r.chunk_no, r.speaker): r.global_id for r in out.collect()}
    assert got[0, "s0"] == got[1, "s1"] == got[2, "s0"] == got[2, "s1"] == got[7, "s0"] == "speaker_0"
    assert got[0, "s1"] == got[1, "s0"] == "speaker_1"
    assert got[8, "s0"] == "speaker_2"
