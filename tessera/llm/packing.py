"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention within documents). Documents, longest first, go to
the sequence of lowest cost that has room for all their tokens; if none has, a new sequence begins. A document longer than a
sequence is cut into full pieces and a rest, so no token is lost.

Lengths are the tokens that the package's BPE encoder gives for each whole text, or any column of lengths.

The open sequences are kept by the room they have left, the cheapest of each room in a heap and the minima in a tree over the
rooms, so a piece costs the logarithm of the capacity.

Scale: lengths are counted once and written; pieces are then hashed into groups of about ``GROUP`` and each group is packed
alone, in one task, whose work is bounded whatever the texts. Only ids and sizes are shuffled, never texts.

Edge cases: a null or empty text has 0 tokens and is packed as a piece of 0 tokens; equal costs go to the lower sequence, and
equal lengths are taken in order of id (nulls first), then hash of the text; repeated rows are packed each; an empty table
packs into nothing; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import checkpoint
from tessera.llm.common import pieces as slices

#: Tokens of a sequence; pieces packed together; rows encoded together.
CAPACITY, GROUP, ENCODED = 4096, 65_536, 256
#: Cost per token and per squared token (attention flops over linear flops for a model width of 4096, a token costs 12 * width).
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 4096)

SCHEMA = "doc_id long, piece int, n_tokens int, sequence string, token_start int, cost double"


def pack(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, first token, cost) of pieces of the given sizes, which descend and fit the capacity."""
    n = len(sizes)
    seq, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cost = linear * sizes + quadratic * sizes.astype(np.float64) ** 2
    leaves = 1 << capacity.bit_length()
    none = (math.inf, n)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # (load, sequence) by room
    least = [none] * (2 * leaves)  # of the rooms below each node

    def update(room: int) -> None:
        k = leaves + room
        least[k] = heaps[room][0] if heaps[room] else none
        while k > 1:
            k >>= 1
            least[k] = min(least[2 * k], least[2 * k + 1])

    left_of: dict[int, int] = {}
    used = 0
    for k, (s, c) in enumerate(zip(sizes.tolist(), cost.tolist())):
        # the minimum over all rooms from s on
        best, left, right = none, leaves + s, 2 * leaves
        while left < right:
            if left & 1:
                best = min(best, least[left])
                left += 1
            left >>= 1
            right >>= 1
        if best is none:
            load, to, room, used = 0.0, used, capacity, used + 1
        else:
            load, to = best
            room = left_of[to]
            heapq.heappop(heaps[room])
            update(room)
        seq[k], start[k] = to, capacity - room
        left_of[to] = room - s
        heapq.heappush(heaps[room - s], (load + c, to))
        update(room - s)
    return seq, start, cost


def counted(docs: DataFrame, path: str = bpe.RANKS) -> DataFrame:
    """doc_id, h (hash of the text) and n (tokens of the whole text by the BPE encoder) of every row."""

    def run(batches):
        c = bpe.codec(path)
        for whole in slices(batches, 1):
            for at in range(0, whole.num_rows, ENCODED):
                b = whole.slice(at, ENCODED)
                n = c.count(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "h", "n"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, h long, n long")


def packed(docs: DataFrame, capacity: int = CAPACITY, tokens=None, path: str = bpe.RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, sequence, token_start (place in the sequence) and cost.

    tokens: a column with each row's tokens; by default what the encoder of the vocabulary at path gives for the text.
    """
    text = F.col("text").cast("string")
    sized = checkpoint(counted(docs, path) if tokens is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), tokens.cast("long").alias("n")))
    count = sized.agg(F.sum(F.expr(f"greatest(1L, (coalesce(n, 0L) + {capacity - 1}) div {capacity})"))).first()[0] or 0
    pieces = sized.select("doc_id", "h", F.posexplode(F.expr(f"transform(sequence(0L, greatest(0L, (n - 1) div {capacity})), i -> cast(least({capacity}, n - i * {capacity}) as int))")).alias("piece", "n_tokens")).withColumn(
        "g", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(max(1, -(-count // GROUP)))).cast("int")
    )

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_tokens", "doc_id", "h", "piece"], ascending=[False, True, True, True], na_position="first", kind="stable")
        seq, start, cost = pack(p["n_tokens"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "piece": p["piece"], "n_tokens": p["n_tokens"], "sequence": [f"{g}-{s}" for g, s in zip(p["g"], seq)], "token_start": start, "cost": cost})

    return pieces.groupBy("g").applyInPandas(run, SCHEMA)
