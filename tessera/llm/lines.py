"""Line dedup by a segment-partition edit join.

A line repeats an earlier one (in order of doc_id, then place) if their edit distance is at most the threshold for the
shorter one's length. The join is exact: a line of threshold t is cut into t + 1 segments, and any line within t edits holds
one of them unchanged, at a place that the lengths narrow down; so each line lists its own segments and probes, for every
length that a partner may have, the few substrings that can match. What shares a segment is verified by banded bit-parallel
edit distance, many pairs at once in numpy, on whole lines, but for pairs whose counts of bytes alone take more edits. Lengths and edits are counted in bytes of UTF-8.

The threshold is a parameter: one edit for each ``per`` bytes, ``edits`` at most (31 is the most that the words of the
verification hold).

``drop_repeats`` takes repeated lines out of documents, whatever is left of them. Only where a document copies another as a
whole, to be judged as a document by whoever looks for near duplicates, are the lines that it has from that one left in it.
Of the documents that its lines repeat it is held against the one that shares most: it counts as its copy if the lines in
common, once each, are at least ``least`` of the bytes of both documents' different lines together, and the Jaccard similarity
of the two whole texts' word n-grams is at least ``theta``. Such a copy loses what the document it copies loses, and every
line that it has twice.

Scale: segments travel as 64-bit hashes in record blobs; text is shuffled for lines that share a segment, once per shared
segment (a broadcast bit map of fixed size keeps nearly all others where they are), and documents once, when lines are taken out, unless the list of lines is small (``BROADCAST_BYTES``).

Edge cases: lines end at a line feed; spaces, tabs and carriage returns around a line don't count; blank lines stay and
repeat nothing; a null or empty text has no lines; lines of any length are compared whole; rows that repeat a doc_id and
text are one document; null ids come first; an empty table gives an empty result; columns beside doc_id and text are kept
untouched, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import blobs
from tessera.llm.common import buckets, checkpoint, fresh, ngram_sets, pieces
from tessera.llm.jaccard import NGRAM, THETA

#: Edits allowed at most, and one for so many bytes; part of the lines' bytes in common from which a document may be a copy.
EDITS, PER, LEAST = 2, 10, 0.1
#: Characters compared at once, and pairs.
CELLS, PAIRS = 1 << 21, 50_000
AROUND = b" \t\r"
#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits of the largest map of wanted lines (32 MB), and bytes of it that travel together.
MAP_BITS, BLOCK = 1 << 28, 1 << 13


def threshold(length: int, edits: int = EDITS, per: int = PER) -> int:
    """Edits allowed for a pair whose shorter line has this length."""
    return min(edits, length // per)


def segments(length: int, edits: int = EDITS, per: int = PER) -> list[tuple[int, int]]:
    """(place, length) of the segments of a line, as even as can be, the longer ones last."""
    parts = threshold(length, edits, per) + 1
    short, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def windows(length: int, edits: int = EDITS, per: int = PER) -> list[tuple[int, int, int, int, int]]:
    """(partner's length, segment, first place, last place, size) that a line of this length probes."""
    out = []
    for own in range(max(1, length - edits), length + 1):
        t, delta = threshold(own, edits, per), length - own
        if delta > t:
            continue
        for k, (at, size) in enumerate(segments(own, edits, per)):
            first = max(at - k, at + delta - (t - k), 0)
            last = min(at + k, at + delta + (t - k), length - size)
            if first <= last:
                out.append((own, k, first, last, size))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hashed_lines(text: str | None):
    """(number, hash, line) of the lines of a text that aren't blank."""
    if text:
        for k, raw in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
            line = raw.strip(AROUND)
            if line:
                yield k, xxh64_intdigest(line, len(line)), line


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), line (number), h (hash), n (bytes) and total (bytes of the text's different lines) of every line that isn't blank."""

    def run(batches):
        for b in pieces(batches, 1):
            owner, number, hashes, size, total = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = [(n, h, len(line)) for n, h, line in hashed_lines(text)]
                whole = sum({h: n for _, h, n in found}.values())
                owner += [k] * len(found)
                number += [n for n, _, _ in found]
                hashes += [h for _, h, _ in found]
                size += [n for _, _, n in found]
                total += [whole] * len(found)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(number, pa.int32()), pa.array(_signed(np.array(hashes, np.uint64))), pa.array(size, pa.int32()), pa.array(total, pa.int64())], names=["doc_id", "copy", "line", "h", "n", "total"])

    return _rows(docs).mapInArrow(run, "doc_id long, copy long, line int, h long, n int, total long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("copy"))


def listed(docs: DataFrame, n_buckets: int, edits: int = EDITS, per: int = PER) -> DataFrame:
    """Segments that lines list and substrings that they probe, as blobs: bucket, own_keys, own, probe_keys, probe."""

    def run(batches):
        cuts: dict[int, tuple] = {}
        for b in pieces(batches, 0):
            seen: set[int] = set()
            keys, who, is_probe = [], [], []
            for text in b.column(0).to_pylist():
                for _, h, line in hashed_lines(text):
                    if h in seen:
                        continue
                    seen.add(h)
                    n = len(line)
                    if n not in cuts:
                        if len(cuts) > 5000:
                            cuts.clear()
                        own = [(at, at + size, n * 32 + k) for k, (at, size) in enumerate(segments(n, edits, per))] if threshold(n, edits, per) else []
                        probe = [(p, p + size, partner * 32 + k) for partner, k, first, last, size in windows(n, edits, per) if threshold(partner, edits, per) for p in range(first, last + 1)]
                        cuts[n] = own + probe, len(own)
                    parts, owned = cuts[n]
                    keys += [xxh64_intdigest(line[s:e], seed) for s, e, seed in parts]
                    who += [h] * len(parts)
                    is_probe += [False] * owned + [True] * (len(parts) - owned)
            if not keys:
                continue
            keys, who, is_probe = np.array(keys, np.uint64), np.array(who, np.uint64), np.array(is_probe)
            out = []
            for bucket, (k, w, p) in blobs.split((keys % np.uint64(n_buckets)).astype(np.int64), n_buckets, [keys, who, is_probe]):
                out.append((bucket, k[~p].tobytes(), w[~p].tobytes(), k[p].tobytes(), w[p].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[c] for r in out], pa.binary()) for c in range(1, 5))], names=["bucket", "own_keys", "own", "probe_keys", "probe"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, own_keys binary, own binary, probe_keys binary, probe binary")


def shared(entries: DataFrame) -> DataFrame:
    """Lines that meet at a segment: bucket, key, h, own (lists the segment) and probe (probes it)."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        keys, own = blobs.join(table, "own_keys", np.uint64), blobs.join(table, "own", np.uint64)
        probe_keys, probe = blobs.join(table, "probe_keys", np.uint64), blobs.join(table, "probe", np.uint64)
        all_keys, who = np.concatenate([keys, probe_keys]), np.concatenate([own, probe])
        role = np.repeat(np.array([1, 2], np.int8), [len(keys), len(probe_keys)])
        order = np.lexsort((who, all_keys))
        all_keys, who, role = all_keys[order], who[order], role[order]
        if len(all_keys):
            new_line = np.concatenate([[True], (all_keys[1:] != all_keys[:-1]) | (who[1:] != who[:-1])])
            at = np.flatnonzero(new_line)
            role = np.bitwise_or.reduceat(role, at)
            all_keys, who = all_keys[at], who[at]
            at = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
            roles, sizes = np.bitwise_or.reduceat(role, at), np.diff(np.append(at, len(all_keys)))
            keep = np.repeat((roles == 3) & (sizes > 1), sizes)
            found = [all_keys[keep], who[keep], role[keep]]
        else:
            found = [all_keys, who, role]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array(np.full(len(found[0]), bucket, np.int32)), "key": pa.array(_signed(found[0])), "h": pa.array(_signed(found[1])), "role": pa.array(found[2].astype(np.int32))})

    return entries.groupBy("bucket").applyInArrow(run, "bucket int, key long, h long, role int")


def within(first: list[bytes], second: list[bytes], limit: np.ndarray) -> np.ndarray:
    """Edit distances of pairs, or limit + 1 where they exceed it.

    Bit-parallel in a band: one word per pair holds the differences along a column, of which only the cells within the limit
    of the diagonal matter (Hyyrö's banded form of Myers's algorithm); all pairs take a step at once.
    """
    out = np.empty(len(first), np.int64)
    first, second = map(list, zip(*map(_differing, first, second))) if first else ([], [])
    sizes = np.array([max(len(a), len(b)) for a, b in zip(first, second)], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        count = max(1, min(len(order) - at, CELLS // int(sizes[order[at]] + 8)))
        while count > 1 and count * int(sizes[order[at + count - 1]]) > 2 * CELLS:
            count //= 2
        chosen = order[at : at + count]
        out[chosen] = _banded([first[k] for k in chosen], [second[k] for k in chosen], limit[chosen])
        at += count
    return out


def _differing(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Two lines without what they begin and end with in common, which takes no edits; short ones as they are."""
    n = min(len(a), len(b))
    if n < 256:
        return a, b
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    same = x[len(a) - n + head :][::-1] == y[len(b) - n + head :][::-1]
    tail = len(same) if same.all() else int(same.argmin())
    return a[head : len(a) - tail], b[head : len(b) - tail]


def _bytes(texts: list[bytes], width: int, fill: int, before: int) -> np.ndarray:
    """Bytes as numbers, one column per text, with filling before and after."""
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    out = np.full((len(texts), width), fill, np.uint16)
    out[np.repeat(np.arange(len(texts)), lengths), before + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.ascontiguousarray(out.T)


def _banded(a: list[bytes], b: list[bytes], limit: np.ndarray) -> np.ndarray:
    band = int(limit.max())
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = int(max(n.max(), m.max()))
    pattern = _bytes(a, width + 2 * band + 2, 256, band)
    text = _bytes(b, width, 257, 0)
    one, top = np.uint64(1), np.uint64(2 * band)
    mask = np.uint64((1 << (2 * band + 1)) - 1)
    # bit d stands for row j - band + d of column j; above row 1 there are no differences at first
    plus = np.full(len(a), ((1 << (2 * band + 1)) - 1) ^ ((1 << band) - 1), np.uint64)
    minus = np.zeros(len(a), np.uint64)
    score = np.full(len(a), band, np.int64)  # of the lowest row of the band
    result = np.where(m == 0, n, 0)
    low = n - m + band
    ends = np.bincount(m, minlength=width + 1)
    for j in range(width):
        match = np.zeros(len(a), np.uint64)
        for d in range(2 * band + 1):
            match |= (pattern[j + d] == text[j]).astype(np.uint64) << np.uint64(d)
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up = (minus | ~(zero | plus)) & mask
        down = zero & plus
        score += 1 - ((zero >> top) & one).astype(np.int64)
        shifted = zero >> one
        plus = (down | ~(shifted | up)) & mask
        minus = shifted & up
        if ends[j + 1]:
            # from the lowest row of the band up to the pattern's last one, by the differences of this column
            s = score.copy()
            for d in range(2 * band):
                step = ((plus >> np.uint64(d)) & one).astype(np.int64) - ((minus >> np.uint64(d)) & one).astype(np.int64)
                s -= np.where(d >= low, step, 0)
            result = np.where(m == j + 1, s, result)
    return np.where((result <= limit) & (np.abs(n - m) <= limit), result, limit + 1)


def bags(lines: pa.Array) -> np.ndarray:
    """How often each line has each byte, 255 times at most, bytes taken by their lowest six bits."""
    out, at, ends = np.zeros((len(lines), 64), np.uint8), 0, np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64))
    while at < len(lines):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        flat = np.frombuffer(b"".join(lines.slice(at, to - at).to_pylist()), np.uint8)
        owner = np.repeat(np.arange(to - at) * 64, np.diff(np.concatenate([[before], ends[at:to]])))
        out[at:to] = np.minimum(np.bincount(owner + (flat & 63), minlength=64 * (to - at)), 255).reshape(-1, 64)
        at = to
    return out


def edits_at_least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edits that lines of these bags are apart at least: one mends one byte too many and one too few."""
    most = np.maximum(x, y)
    return np.maximum((most - x).sum(axis=1, dtype=np.uint16), (most - y).sum(axis=1, dtype=np.uint16))


def verified(meetings: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """Pairs of different lines within the threshold: x, y (hashes, x < y) and edits. meetings: bucket, key, h, role, line.

    A pair that meets at several segments may come more than once.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, hs, roles = keys[order], table.column("h").to_numpy()[order], table.column("role").to_numpy()[order]
        lines = table.column("line").combine_chunks().take(pa.array(order))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        names, where = np.unique(hs, return_index=True)
        each = lines.take(pa.array(where))
        sizes, held = pc.binary_length(each).to_numpy().astype(np.int64), bags(each)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            x, y = (np.concatenate(c) for c in zip(*todo))
            todo.clear()
            one = np.unique(np.searchsorted(names, x) * len(names) + np.searchsorted(names, y))
            x, y = one // len(names), one % len(names)
            limit = np.minimum(edits, np.minimum(sizes[x], sizes[y]) // per)
            keep = np.concatenate([edits_at_least(held[x[k : k + PAIRS]], held[y[k : k + PAIRS]]) <= limit[k : k + PAIRS] for k in range(0, len(x), PAIRS)] or [np.zeros(0, bool)])
            x, y, limit = x[keep], y[keep], limit[keep]
            n = within(each.take(pa.array(x)).to_pylist(), each.take(pa.array(y)).to_pylist(), limit)
            keep = n <= limit
            found.append((names[x][keep], names[y][keep], n[keep]))

        waiting = 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            group = hs[s:e]
            own, probe = group[roles[s:e] & 1 > 0], group[roles[s:e] & 2 > 0]
            step = max(1, PAIRS // max(1, len(probe)))
            for at in range(0, len(own), step):  # a segment of many lines in slices
                x, y = np.repeat(own[at : at + step], len(probe)), np.tile(probe, len(own[at : at + step]))
                other = x != y
                todo.append((np.minimum(x, y)[other], np.maximum(x, y)[other]))
                waiting += len(x)
                if waiting >= PAIRS:
                    flush()
                    waiting = 0
        if todo:
            flush()
        x, y, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"x": pa.array(x), "y": pa.array(y), "edits": pa.array(n.astype(np.int32))})

    return meetings.groupBy("bucket").applyInArrow(run, "x long, y long, edits int")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Bytes of a map with the bits that the lowest bits of the hashes (column h, written already) name: 64 bits for a hash, or MAP_BITS in all if that is less."""
    size = min(MAP_BITS, max(8 * BLOCK, 1 << (64 * hashes.count()).bit_length()))

    def run(batches):
        there = np.zeros(size >> 3, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(there, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        blocks = there.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in used], pa.binary())], names=["block", "bits"])

    def add(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in table.column("bits").to_pylist()], axis=0)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema, out = "block int, bits binary", np.zeros((size // 8 // BLOCK, BLOCK), np.uint8)
    for r in hashes.select("h").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect():  # MAP_BITS whatever the input
        out[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.reshape(-1)


def line_texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """h and line (bytes), once a slice, of every line that isn't blank and whose hash has its bit in the map, which some others have, too."""
    sent, size = docs.sparkSession.sparkContext.broadcast(wanted), 8 * len(wanted)

    def run(batches):
        bits = sent.value
        for b in pieces(batches, 0):
            found = {h: line for text in b.column(0).to_pylist() for _, h, line in hashed_lines(text)}
            hashes = np.fromiter(found, np.uint64, len(found)) & np.uint64(size - 1)
            there = bits[(hashes >> np.uint64(3)).astype(np.int64)] >> (hashes & np.uint64(7)).astype(np.uint8) & 1
            found = {h: line for (h, line), k in zip(found.items(), there.tolist()) if k}
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.fromiter(found, np.uint64, len(found)))), pa.array(list(found.values()), pa.binary())], names=["h", "line"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, line binary")


def small(df: DataFrame, size=None) -> DataFrame:
    """df with a broadcast hint if its rows take few bytes; df must be cheap to count. size: a row's bytes, 32 by default."""
    return df.hint("broadcast") if (df.agg(F.sum(F.lit(32) if size is None else size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _repeats(docs: DataFrame, edits: int, per: int) -> DataFrame:
    """repeats() with n and total of the line's own document, too (the line it repeats repeats one itself), and of_copy and of_total of the earlier document."""
    if not 0 <= edits <= 31:
        raise ValueError("edits must be from 0 to 31")
    met = checkpoint(shared(listed(docs, buckets(docs), edits, per)))
    wanted = checkpoint(met.select("h").distinct())
    texts = line_texts(docs, bit_map(wanted)).dropDuplicates(["h"])
    pairs = checkpoint(verified(met.join(texts, "h"), edits, per).distinct())
    seen = checkpoint(occurrences(docs))
    place = F.struct("doc_id", "line", "copy", "total")
    firsts = seen.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("h"), F.col("y").alias("other"), "edits"), F.struct(F.col("y").alias("h"), F.col("x").alias("other"), "edits"))).alias("p")).select("p.*")
    named = each.join(firsts.select("h", "first"), "h").join(firsts.select(F.col("h").alias("other"), F.col("first").alias("other_first")), "other")
    late = named.where("other_first < first").groupBy("h").agg(F.min(F.struct("other_first", "edits")).alias("of"))
    repeated = firsts.join(late, "h", "left").where("times > 1 or of is not null").select("h", "first", "of")
    return (
        seen.join(repeated, "h")
        .select("doc_id", "copy", "line", "n", "total", ((place != F.col("first")) & F.col("of").isNotNull()).alias("too"), F.when(place == F.col("first"), F.col("of")).otherwise(F.struct(F.col("first").alias("other_first"), F.lit(0).alias("edits"))).alias("of"))
        .where("of is not null")
        .distinct()
        .select("doc_id", "copy", "line", "n", "total", "too", F.col("of.other_first.doc_id").alias("of_doc_id"), F.col("of.other_first.line").alias("of_line"), F.col("of.edits").alias("edits"), F.col("of.other_first.copy").alias("of_copy"), F.col("of.other_first.total").alias("of_total"))
    )


def repeats(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """Every line that repeats an earlier one: doc_id, copy, line, of_doc_id, of_line (the earliest such line) and edits.

    An exact repeat counts as 0 edits of the line's first occurrence; a first occurrence may be within some edits of an
    earlier line.
    """
    return _repeats(docs, edits, per).select("doc_id", "copy", "line", "of_doc_id", "of_line", "edits")


def alike_texts(docs: DataFrame, pairs: DataFrame, ngram: int, theta: float) -> DataFrame:
    """The pairs (copy, of_copy: hashes of texts) whose texts have a Jaccard similarity of word n-grams of at least theta."""
    wanted = checkpoint(pairs.select(F.explode(F.array("copy", "of_copy")).alias("copy")).distinct())
    texts = _rows(docs).select("copy", "text").join(small(wanted), "copy", "left_semi").dropDuplicates(["copy"])
    both = pairs.join(texts.select(F.col("copy").alias("of_copy"), F.col("text").alias("of_text")), "of_copy").join(texts, "copy").select("copy", "of_copy", "text", "of_text")

    def run(batches):
        for b in pieces(batches, 3):
            keep = []
            for x, y in zip(ngram_sets(b.column(2), ngram), ngram_sets(b.column(3), ngram)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and common >= theta * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["copy", "of_copy"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "copy long, of_copy long")


def going(docs: DataFrame, edits: int = EDITS, per: int = PER, least: float = LEAST, ngram: int = NGRAM, theta: float = THETA) -> DataFrame:
    """doc_id, copy and lines (numbers) of the documents that lose lines."""
    # a document's lines that repeat one and the same line of another count once
    same = Window.partitionBy("doc_id", "copy", "of_doc_id", "of_copy", "of_line").orderBy("line")
    marked = _repeats(docs, edits, per).withColumn("again", F.row_number().over(same) > 1)
    own = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("copy") == F.col("of_copy"))
    by_source = marked.groupBy("doc_id", "copy", "of_doc_id", "of_copy").agg(
        F.sum(F.when(F.col("again"), 0).otherwise(F.col("n"))).alias("common"),
        F.first("total").alias("total"),
        F.first("of_total").alias("of_total"),
        F.collect_list("line").alias("lines"),
        F.collect_list(F.when(F.col("again") | F.col("too"), F.col("line"))).alias("also"),
        F.first(own).alias("own"),
    )
    part = F.when(F.col("own"), 0.0).otherwise(F.col("common") / (F.col("total") + F.col("of_total") - F.col("common")))
    by_document = checkpoint(
        by_source.groupBy("doc_id", "copy").agg(F.max(F.struct(part.alias("part"), "of_doc_id", "of_copy", "also")).alias("most"), F.collect_list(F.struct("of_doc_id", "of_copy", "lines")).alias("each"))
    )
    maybe = by_document.where(F.col("most.part") >= least).select("copy", F.col("most.of_copy").alias("of_copy")).distinct()
    alike = maybe.where("copy = of_copy").union(alike_texts(docs, checkpoint(maybe.where("copy <> of_copy")), ngram, theta)).withColumn("alike", F.lit(True))
    others = F.filter("each", lambda e: ~(e["of_doc_id"].eqNullSafe(F.col("most.of_doc_id")) & (e["of_copy"] == F.col("most.of_copy"))))
    lines_of = lambda each: F.flatten(F.transform(each, lambda e: e["lines"]))
    return (
        by_document.withColumn("of_copy", F.col("most.of_copy"))
        .join(alike, ["copy", "of_copy"], "left")
        .select("doc_id", "copy", F.when((F.col("most.part") >= least) & F.col("alike"), F.concat(lines_of(others), F.col("most.also"))).otherwise(lines_of(F.col("each"))).alias("lines"))
        .where("size(lines) > 0")
    )


def drop_repeats(docs: DataFrame, edits: int = EDITS, per: int = PER, least: float = LEAST) -> DataFrame:
    """docs without repeated lines, all columns; n_chars, where there is one, follows the text. Copies keep what they have from the document they copy."""
    of, copy, lines, kept = fresh(docs.columns, "of", "copy", "lines", "kept")
    gone = checkpoint(going(docs, edits, per, least).select(F.col("doc_id").alias(of), F.col("copy").alias(copy), F.col("lines").alias(lines)))
    text = docs["text"].cast("string")
    joined = docs.join(small(gone, F.lit(40) + 4 * F.size(lines)), docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(copy)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(lines, i)), "\n")
    out = joined.withColumn(kept, F.when(F.col(lines).isNotNull(), left).otherwise(text))
    return out.select(*(F.col(kept).alias(c) if c == "text" else F.length(kept).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[f"`{c.replace('`', '``')}`"] for c in docs.columns))


SQL = f"""
with l as (select doc_id, trim(u.line, ' ' || chr(9) || chr(13)) as text, (u.n - 1)::int as line from documents, lateral (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n) u),
o as (select doc_id, line, text, min((doc_id, line)) over (partition by text) as first from l where text <> ''),
f as (select text, min((doc_id, line)) as first, strlen(text) as n, least({EDITS}, strlen(text) // {PER}) as t from l where text <> '' group by text),
p as (select a.first as x, b.first as y, levenshtein(a.text, b.text) as edits from f a join f b on b.n between a.n and a.n + a.t and a.text <> b.text where levenshtein(a.text, b.text) <= a.t),
late as (select least(x, y) as other, greatest(x, y) as first, min(edits) as edits from p group by 1, 2),
of_ as (select first, min((other, edits)) as o from late group by 1)
select doc_id, line, first[1] as of_doc_id, first[2] as of_line, 0::int as edits from o where (doc_id, line) <> first
union all
select first[1] as doc_id, first[2] as line, o[1][1] as of_doc_id, o[1][2] as of_line, o[2]::int as edits from of_
"""
