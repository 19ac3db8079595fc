import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lines


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


words = st.binary(max_size=14).map(lambda b: bytes(x % 3 + 97 for x in b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words, words, st.integers(0, 4)), min_size=1, max_size=8))
def test_banded_distance(pairs):
    limit = np.array([t for *_, t in pairs])
    got = lines.within([a for a, *_ in pairs], [b for _, b, _ in pairs], limit)
    assert got.tolist() == [min(distance(a, b), t + 1) for a, b, t in pairs]


def brute(rows):
    seen = sorted({(i, k, t, x.strip(" \t\r").encode()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")}, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    first, out = {}, set()
    for i, k, _, x in seen:
        if x in first:
            out.add((i, k, *first[x], 0))
        else:
            for y, at in first.items():  # in order of place
                t = lines.threshold(min(len(x), len(y)))
                if abs(len(x) - len(y)) <= t and (d := distance(x, y)) <= t:
                    out.add((i, k, *at, d))
                    break
            first[x] = (i, k)
    return out


def run(spark, rows):
    got = lines.repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("copy").collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


def edited(rng, s):
    s = list(s)
    for _ in range(rng.integers(0, 4)):
        at = rng.integers(0, len(s) + 1)
        kind = rng.integers(3)
        if kind == 0:
            s.insert(at, "xé"[rng.integers(2)])
        elif at < len(s):
            s[at : at + 1] = [] if kind == 1 else ["y"]
    return "".join(s)


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcde "), n)) for n in (3, 9, 10, 12, 19, 20, 21, 33, 60, 150)]
    rows = [(k, "\n".join(edited(rng, base[j]) for j in rng.integers(0, len(base), 6))) for k in range(60)]
    rows += [(None, "\n".join(base)), (100, None), (101, ""), (102, "\n \n\t\r\n"), (103, "a\na\n a \nb"), (3, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_very_long_lines(spark):
    line = "".join(np.random.default_rng(2).choice(list("abc "), 40_000)).strip()
    rows = [(1, line), (2, line[:20_000] + "z" + line[20_000:] + "z"), (3, line[:100] + "zz" + line[100:] + "z"), (4, line)]
    assert run(spark, rows) == {(2, 0, 1, 0, 2), (4, 0, 1, 0, 0)}


def test_empty_table(spark):
    assert run(spark, []) == set()


def alike(a: str, b: str) -> bool:
    def grams(text):
        w = re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", text.lower())
        return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    x, y = grams(a), grams(b)
    return bool(x & y) and len(x & y) >= 0.5 * len(x | y) - 1e-9


def brute_left(rows):
    """What drop_repeats leaves of texts with different ids, said again."""
    texts = {i: t for i, t in rows}
    different = {i: {x.strip(" \t\r").encode() for x in (t or "").split("\n")} - {b""} for i, t in rows}
    found = brute(rows)
    goes = {(i, k) for i, k, *_ in found}
    out = {}
    for i, t in rows:
        own = sorted(r for r in found if r[0] == i)
        sources = {}
        for _, k, j, at, _ in own:
            size = len((t.split("\n")[k]).strip(" \t\r").encode())
            sources.setdefault(j, {}).setdefault(at, (k, size))
        best = max(((sum(n for _, n in s.values()) / (sum(map(len, different[i])) + sum(map(len, different[j])) - sum(n for _, n in s.values())) if j != i else 0.0, j is not None, j or 0, j) for j, s in sources.items()), default=(0.0, False, 0, None))
        whole = best[0] >= lines.LEAST and alike(t, texts[best[3]])
        gone = {k for _, k, j, at, d in own if not (whole and j == best[3] and sources[j][at][0] == k and not (d == 0 and (j, at) in goes))}
        out[i] = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_drop_repeats(spark):
    shared = "This line stands in many documents."
    second, fourth = "The second text has another line, of course, " * 3 + "yes.", "Only a blank line and a longer line are left here, " * 3 + "so."
    rows = [(1, f"{shared}\nThe first text has a line of its own here.", "a", 5, 1), (2, f"{second}\n{shared}", "b", 5, 2), (3, shared, "c", 5, 3), (None, None, "d", None, 4), (4, f"{shared} \n\n{fourth}", "e", 5, 5), (6, f"{second}\n{fourth}\n{shared}", "f", 5, 6), (7, f"{second}\nand\n{second}\n{shared}", "g", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string, n_chars long, `__of.it` int").withColumns({c: lines.F.lit(7) for c in ("of", "_of", "lines", "kept", "h", "alike", "__kept")})
    out = lines.drop_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == brute_left([r[:2] for r in rows])
    assert got[1].text == rows[0][1]
    assert got[2].text == second and got[2].n_chars == len(second)
    assert got[3].text == "" and got[3].n_chars == 0
    assert got[4].text == "\n" + fourth
    assert got[7].text == f"{second}\nand"  # a copy of the second: keeps what that one keeps, once
    assert got[None].text is None and got[None].copy == "d" and got[4]["__of.it"] == 5


def test_drop_repeats_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice(["red", "green", "blue", "sea", "sky", "tree", "house"], rng.integers(4, 14))) + f" {k}" for k in range(40)]
    rows = [(k, "\n".join(base[j] for j in rng.integers(0, 40, 6))) for k in range(12)]
    for k in range(40):  # copies of a document, changed a little
        own = rows[rng.integers(0, 12)][1].split("\n")
        for at in rng.integers(0, 6, rng.integers(0, 4)):
            own[at] = edited(rng, own[at]) if rng.integers(2) else base[rng.integers(40)]
        rows.append((100 + k, "\n".join(own)))
    got = {r.doc_id: r.text for r in lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_left(rows)


def test_drop_repeats_of_nothing(spark):
    assert lines.drop_repeats(spark.createDataFrame([], "doc_id long, text string, of int")).collect() == []


def test_edits_are_a_parameter(spark):
    a = "abcdefghij" * 12
    rows = [(1, a), (2, a[:30] + "XYZ" + a[34:70] + "UV" + a[72:]), (3, "other " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.repeats(docs).collect() == []
    assert [(r.doc_id, r.of_doc_id, r.edits) for r in lines.repeats(docs, 8).collect()] == [(2, 1, 6)]


def test_many_lines_that_share_a_segment(spark):
    rows = [(k, f"a beginning that all of the many lines have {(k * 2654435761) % 2**32:032b}{(k * 40503) % 65536:016b}") for k in range(1500)] + [(9999, f"a beginning that all of the many lines have {2654435761 % 2**32:032b}{40503:016b}!")]
    got = lines.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (9999, 1) in {(r.doc_id, r.of_doc_id) for r in got}


def test_shuffled_selection_gives_the_same(spark, monkeypatch):
    rows = [(k, f"a line of some length with a number {k % 4}\nand another") for k in range(20)]
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == brute(rows)


def test_pairs_that_only_share_a_segment_are_not_aligned(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20)) for _ in range(40)]
    rows = [(k, f"the same segment of it {x} {k % 10}{k // 10}") for k, x in enumerate(own)] + [(90, f"the same segment of it {own[3]} xy"), (91, f"the same segment of it {own[3]} xyz1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tries = spark.sparkContext.accumulator(0)
    within = lines.within
    monkeypatch.setattr(lines, "within", lambda a, b, limit: (tries.add(len(a)), within(a, b, limit))[1])
    assert [(r.doc_id, r.of_doc_id, r.edits) for r in lines.repeats(docs).sort("doc_id").collect()] == [(90, 3, 2), (91, 90, 2)]
    assert 0 < tries.value <= 20


def test_bags_bound_the_edits_from_below():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = bytes(rng.integers(0, 256, rng.integers(1, 30), np.uint8))
        y = bytearray(x)
        n = int(rng.integers(0, 6))
        for _ in range(n):
            at = int(rng.integers(0, len(y) + 1))
            y[at : at + int(rng.integers(0, 2))] = bytes(rng.integers(0, 256, rng.integers(0, 2), np.uint8))
        held = lines.bags(pa.array([x, bytes(y)], pa.binary()))
        assert lines.edits_at_least(held[:1], held[1:])[0] <= n


def test_a_full_bit_map_loses_no_line(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAP_BITS", 8 * lines.BLOCK)
    rows = [(k, f"line number {k} has words, {k * k} of them") for k in range(300)] + [(1000 + k, f"line number {k} has words. {k * k} of them") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {1000 + k for k in range(300)} <= {r.doc_id for r in lines.repeats(docs).collect()}
    wanted = docs.selectExpr("xxhash64(text) as h").localCheckpoint()
    bits = lines.bit_map(wanted)
    at = np.array([r.h for r in wanted.collect()], np.int64).view(np.uint64) & np.uint64(8 * len(bits) - 1)
    assert (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all()
    assert int(np.bitwise_count(bits).sum()) == len(np.unique(at))
