"""Speaker identity: nearest exemplar, relabelling, identities carried across chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import cosine

THRESHOLD, MEMORY = 0.3, 5
#: Exemplars up to which they are sent to every task.
BROADCAST_ROWS = 50_000


def gold_first(files: DataFrame, name: str, order: str, embedding: str = "embedding") -> DataFrame:
    """One exemplar per name, the first by order: name, ord, embedding."""
    first = files.withColumn("rn", F.row_number().over(W.partitionBy(name).orderBy(order))).where("rn = 1")
    return first.select(F.col(name).alias("name"), F.col(order).alias("ord"), F.col(embedding).alias("embedding"))


def identify(voices: DataFrame, gold: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, name and similarity: the exemplar most like each voice if its cosine is over the threshold, else null.

    The exemplars are few and are broadcast up to BROADCAST_ROWS; the best one is picked by a partial aggregation, so voices
    times exemplars are never shuffled. A missing embedding has similarity 0; of equals the first by ord wins.
    """
    g = gold.select("name", "ord", F.col("embedding").alias("g"))
    g = F.broadcast(g) if gold.count() <= BROADCAST_ROWS else g
    both = voices.select("id", "embedding").join(g, how="cross").select("id", "name", "ord", F.coalesce(cosine("embedding", "g"), F.lit(0.0)).alias("sim"))
    best = both.groupBy("id").agg(F.max_by(F.struct("name", "sim"), F.struct("sim", -F.col("ord"))).alias("best"))
    named = voices.select("id").join(best, "id", "left")
    return named.select("id", F.when(F.col("best.sim") > threshold, F.col("best.name")).alias("name"), F.col("best.sim").alias("similarity"))


def relabel(segments: DataFrame, names: DataFrame | None) -> DataFrame:
    """Segments with speakers replaced by their names (columns speaker, name); unnamed speakers keep their label.

    Speakers with one name are merged, all their segments kept. Without names nothing changes.
    """
    if names is None:
        return segments
    return segments.join(names.select("media_id", "speaker", "name"), ["media_id", "speaker"], "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


def carry(chunked: DataFrame, threshold: float = THRESHOLD, memory: int = MEMORY) -> DataFrame:
    """Global speaker ids over the chunks of a recording: media_id, chunk_no, speaker, global_id.

    chunked: media_id, chunk_no, speaker, embedding, weight. Chunk by chunk, a local speaker takes the id of the most similar
    speaker of the last ``memory`` chunks (weighted mean of its vectors there) if the cosine is over the threshold, else a new
    id. Local speakers that take one id are merged. The fold is sequential within a recording and parallel across them.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["chunk_no", "speaker"], kind="stable")
        past: dict[int, dict[int, list]] = {}
        ids, fresh = [], 0
        for chunk, part in p.groupby("chunk_no", sort=True):
            gold: dict[int, list] = {}
            for c in range(max(0, chunk - memory), chunk):
                for g, (v, w) in past.get(c, {}).items():
                    a = gold.setdefault(g, [0.0, 0.0])
                    a[0], a[1] = a[0] + v * w, a[1] + w
            here: dict[int, list] = {}
            for v, w in zip(part["embedding"], part["weight"]):
                v = None if v is None else np.asarray(v, np.float64)
                best, score = None, threshold
                if v is not None and np.linalg.norm(v) > 0:
                    for g in sorted(gold):
                        m = gold[g][0] / gold[g][1]
                        n = np.linalg.norm(m) * np.linalg.norm(v)
                        s = round(float(m @ v / n), 12) if n > 0 else 0.0
                        if s > score:
                            best, score = g, s
                if best is None:
                    best, fresh = fresh, fresh + 1
                ids.append(best)
                if v is not None:
                    a = here.setdefault(best, [0.0, 0.0])
                    a[0], a[1] = (a[0] * a[1] + v * w) / (a[1] + w), a[1] + w
            past[chunk] = {g: (v, w) for g, (v, w) in here.items()}
            past.pop(chunk - memory, None)
        return pd.DataFrame({"media_id": p["media_id"], "chunk_no": p["chunk_no"], "speaker": p["speaker"], "global_id": [f"speaker_{i}" for i in ids]})

    return chunked.groupBy("media_id").applyInPandas(fold, "media_id long, chunk_no int, speaker string, global_id string")
