"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into words by the usual pattern. All words of a batch that aren't known yet lie in one flat array of symbols.
Each round forms the key of every pair of neighbours within a word, finds its rank by binary search over the sorted pair
keys of the vocabulary, takes the lowest rank of each word and merges all its occurrences, left to right without overlap;
words without a pair that has a rank are done and leave. Decoding gathers the bytes of the tokens from one flat table.

Ranks come from a public vocabulary file, whose path is a parameter. Ids are those of the public encoder for that file.

Edge cases: a null text gives null tokens and a null round trip, an empty one an empty list; repeated rows encode alike; a
text of any length is encoded whole; extra columns are ignored; with no words there are no rounds.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers; a full store keeps what the batch at hand uses.
REMEMBERED = 400_000
NONE = np.int64(1 << 40)


class Sizes(dict):
    """Numbers of tokens by word; a word that isn't known counts 0 at first and is noted in new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        return 0


class Codec:
    """Vocabulary tables and the two directions."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.table = np.frombuffer(b"".join(by_id), np.uint8)
        self.known: dict[str, bytes] = {}
        self.sizes = Sizes()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, in order, and how many each word has. symbols: byte tokens; word: number of each symbol's word, ascending, none empty."""
        done_tokens, done_words = [], []
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)  # of its word
        ranks = np.full(len(symbols), NONE)  # of each symbol with its successor
        at = np.flatnonzero(~last)
        ranks[at] = self.rank(symbols[at], symbols[at + 1])
        while len(symbols):
            starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            over = np.repeat(least == NONE, lengths)
            if over.any():
                done_tokens.append(symbols[over])
                done_words.append(word[over])
            where = np.flatnonzero((ranks == np.repeat(least, lengths)) & ~over)
            # of overlapping hits (runs of neighbours) every second one counts, from the left
            run = np.concatenate([[True], np.diff(where) > 1])[: len(where)]
            first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols[where] = ranks[where]
            last[where] = last[where + 1]
            keep = ~over
            keep[where + 1] = False
            moved = np.cumsum(keep)[where] - 1
            symbols, word, last, ranks = symbols[keep], word[keep], last[keep], ranks[keep]
            # only the pairs that a merged symbol takes part in have new ranks
            before = moved[moved > 0] - 1
            at = np.concatenate([moved, before[~last[before]]])
            ranks[at] = NONE
            at = at[~last[at]]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
        if not done_tokens:
            return np.zeros(0, np.int64), np.zeros(words, np.int64)
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_words)
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=words)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet, together."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        symbols = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        tokens, counts = self.merge(symbols, np.repeat(np.arange(len(data)), lengths), len(data))
        packed, at = tokens.astype(np.int32).tobytes(), 0
        for w, n in zip(words, (counts * 4).tolist()):
            self.known[w] = packed[at : at + n]
            at += n

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Tokens of each text as packed int32."""
        cut = [self.split(t) if t is not None else None for t in texts]
        used = set().union(*(c for c in cut if c))
        if len(self.known) > REMEMBERED:  # what this batch uses stays, usual words among it
            self.known = {w: self.known[w] for w in used.intersection(self.known)}
        new = used.difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) if c is not None else None for c in cut]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text, 0 for a null; every text is gone through once, and words that aren't known are added at the end."""
        if len(self.sizes) > REMEMBERED:
            self.sizes.clear()
        size, out, left = self.sizes.__getitem__, [0] * len(texts), []
        for k, t in enumerate(texts):
            if t:
                out[k] = sum(map(size, self.split(t)))
                if self.sizes.new:
                    left.append((k, self.sizes.new))
                    self.sizes.new = []
        if left:
            words = list(set().union(*(new for _, new in left)))
            data = [w.encode("utf-8", "surrogatepass") for w in words]
            lengths = np.array([len(d) for d in data], np.int64)
            _, counts = self.merge(self.byte[np.frombuffer(b"".join(data), np.uint8)], np.repeat(np.arange(len(data)), lengths), len(data))
            self.sizes.update(zip(words, counts.tolist()))
            for k, new in left:
                out[k] += sum(map(size, new))
        return out

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes that tokens stand for."""
        sizes = self.size[tokens]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.table[np.arange(ends[-1]) + np.repeat(self.start[tokens] - (ends - sizes), sizes)].tobytes()


_made: dict[str, Codec] = {}


def codec(path: str = RANKS) -> Codec:
    """The codec of a vocabulary file, made once per process."""
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def encoded(docs: DataFrame, path: str = RANKS, batch_rows: int = 256) -> DataFrame:
    """doc_id, tokens, n_tokens and round_trip (decoding gives the text back) for every row."""

    def run(batches):
        c = codec(path)
        for whole in pieces(batches, 1):
            for at in range(0, whole.num_rows, batch_rows):
                b = whole.slice(at, batch_rows)
                texts = b.column(1).to_pylist()
                packed = c.encode(texts)
                lists = [np.frombuffer(p or b"", np.int32) for p in packed]
                same = [None if t is None else c.decode(x) == t.encode("utf-8", "surrogatepass") for t, x in zip(texts, lists)]
                none = np.array([p is None for p in packed] + [False])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets, mask=none), pa.array(np.concatenate(lists)))
                sizes = pa.array([len(x) for x in lists], pa.int32(), mask=none[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0), tokens, sizes, pa.array(same, pa.bool_())], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decoded(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and text from doc_id and tokens; bytes that aren't UTF-8 become replacement characters."""

    def run(batches):
        c = codec(path)
        for b in batches:
            out = [None if t is None else c.decode(np.array(t, np.int64)).decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")
