"""Document fingerprints: a threshold-scaled sketch.

The sketch of a text keeps every hash of its word shingles that lies below a fixed fraction of the hash range. Its size
follows the text's, so a short text can be held against a very long one: the share of the short text's kept hashes that the
long one has estimates containment without bias. The sketch of two texts together is the union of theirs.

Edge cases: a null text or one without words has 0 shingles and an empty sketch; a text shorter than a shingle has one
shingle of all its words; repeated rows get equal sketches; extra columns are ignored; nothing is cut off a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ngram_sets, pieces

#: Words of a shingle, and the part of the hash range that is kept: one in so many.
SHINGLE, SCALED = 5, 16


def sketches(docs: DataFrame, shingle: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """doc_id, shingles (distinct, in the whole text) and sketch (sorted kept hashes as signed longs) for every row."""
    limit = np.uint64((1 << 64) // scaled)

    def run(batches):
        for b in pieces(batches, 1):
            sizes, kept = [], []
            for grams in ngram_sets(b.column(1), shingle):
                sizes.append(len(grams))
                kept.append(grams[: np.searchsorted(grams, limit)])
            flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["doc_id", "shingles", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, shingles int, sketch array<long>")


def merged(sketch: DataFrame, by: str) -> DataFrame:
    """The sketch of all texts of a group together: by, sketch. Distinct hashes meet before any list is built."""
    return sketch.select(by, F.explode("sketch").alias("h")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a kept none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; null where neither kept a hash."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
