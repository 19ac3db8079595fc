"""Token counts by a linear longest-match automaton.

Greedy word-piece lengths without building pieces: the vocabulary is a trie; each node has a failure link, to where matching
goes on after the longest pieces of what was read are cut off, and the number of pieces cut off on the way. Reading a word
follows trie edges and failure links only, so the time is linear in its length and nothing but counts is kept. A word that
can't be cut counts as one unknown token, as in the usual word-piece scheme.

Vocabulary: the pieces of a public sentence-piece model; those that begin a word (marked in that model) are matched at a
word's start and the others inside words, whether or not they also begin words. Text is lower-cased and split into runs of
word characters and single other characters; white space separates.

Edge cases: a null or empty text has 0 words and 0 tokens; repeated rows count alike; a word of any length is read whole
(the automaton is linear); extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

#: Where the public vocabulary lies.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"\w+|[^\w\s]")
#: Words remembered with their counts by a worker; a full store is emptied.
REMEMBERED = 200_000


def vocabulary(path: str = VOCABULARY) -> tuple[frozenset[str], frozenset[str]]:
    """(pieces at a word's start, pieces inside a word) of a sentence-piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = set(), set()
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        p = model.id_to_piece(k)
        if p.startswith("▁"):
            if len(p) > 1 and "▁" not in p[1:]:
                first.add(p[1:].lower())
        elif "▁" not in p:
            inner.add(p.lower())
    return frozenset(first), frozenset(inner)


class Automaton:
    """Trie with failure links and counts of the pieces that each failure cuts off."""

    def __init__(self, first, inner):
        # node 0: the word's start; node 1: inside a word, after a piece
        self.edges: list[dict[str, int]] = [{}, {}]
        whole: list[bool] = [False, False]
        order: list[tuple[int, int, str]] = []  # node, parent, symbol
        for root, words in ((0, first), (1, inner)):
            for w in words:
                at = root
                for c in w:
                    to = self.edges[at].get(c)
                    if to is None:
                        to = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                        self.edges[at][c] = to
                        order.append((to, at, c))
                    at = to
                if w:
                    whole[at] = True
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        level, depth = [0, 1], {0: 0, 1: 0}
        parent = {to: (at, c) for to, at, c in order}
        while level:  # breadth first: a failure link leads to a node that is less deep
            for v in level:
                if v < 2:
                    continue
                if whole[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                u, c = parent[v]
                z, pops = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.edges[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][c], pops
            level = [to for v in level for to in self.edges[v].values()]

    def count(self, word: str) -> int:
        """Tokens of one word; 1 where it can't be cut into pieces."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for c in word:
            to = edges[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = edges[at].get(c)
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class Counts(dict):
    """Counts by word; a missing one is computed."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


_made: dict[str, Automaton] = {}


def automaton(path: str = VOCABULARY) -> Automaton:
    """The automaton of a model, made once per process."""
    if path not in _made:
        _made[path] = Automaton(*vocabulary(path))
    return _made[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, words and tokens for every row of docs."""

    def run(batches):
        counts = Counts(automaton(path))
        for b in pieces(batches, 1):
            words, tokens = [], []
            for t in b.column(1).to_pylist():
                found = WORD.findall(t.lower()) if t else []
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "words", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, words long, tokens long")
