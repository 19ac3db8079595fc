"""Words against speaker segments: interval join, timeline, chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import overlap_fraction, rung

WORD_KEY = ("media_id", "turn", "pos")
#: Width of the time bins that long recordings are joined by.
BIN_MS = 60_000


def pair_fractions(words: DataFrame, segments: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Best overlap of each word with each speaker of its recording that it meets: media_id, turn, pos, speaker, fraction.

    An equi-join on recording and time bin with the overlap as a residual condition: a long recording spreads over its bins
    instead of one task comparing all its words with all its segments. A pair that shares several bins meets several times,
    which the maximum absorbs.
    """
    span = lambda f, t: F.explode(F.sequence(F.floor(F.least(f, t) / bin_ms), F.floor(F.greatest(f, t) / bin_ms)))
    w = words.select(*WORD_KEY, "start_ms", "end_ms", span(F.col("start_ms"), F.col("end_ms")).alias("bin"))
    s = segments.select(F.col("media_id").alias("m"), "speaker", "from_ms", "to_ms", span(F.col("from_ms"), F.col("to_ms")).alias("b"))
    met = w.join(s, (F.col("media_id") == F.col("m")) & (F.col("bin") == F.col("b")) & (F.col("from_ms") <= F.col("end_ms")) & (F.col("to_ms") >= F.col("start_ms")))
    return met.groupBy(*WORD_KEY, "speaker").agg(F.max(overlap_fraction("start_ms", "end_ms", "from_ms", "to_ms")).alias("fraction"))


def align(words: DataFrame, segments: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Words with their speakers (sorted, distinct; empty where no segment overlaps).

    All speakers whose best segment reaches the highest step of the ladder that any speaker reaches. Fractions are reduced per
    word before the words come back, so the words themselves are shuffled once.
    """
    best = pair_fractions(words, segments, bin_ms).where("fraction > 0").groupBy(*WORD_KEY).agg(F.max("fraction").alias("top"), F.collect_list(F.struct("speaker", "fraction")).alias("all"))
    chosen = best.select(*WORD_KEY, rung("top").alias("step"), "all").select(*WORD_KEY, F.array_sort(F.transform(F.filter("all", lambda x: x.fraction >= F.col("step")), lambda x: x.speaker)).alias("speakers"))
    return words.join(chosen, list(WORD_KEY), "left").withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))


def timeline(segments: DataFrame, key: str = "media_id") -> DataFrame:
    """Who is speaking from each event on: key, moment, next_moment, active (number of open segments) and speakers.

    A sweep: each segment is +1 at its start and -1 at its end; running sums per speaker say who is open. Events at one time
    count together. A recording's events are read once in the order of time, and only who is open is held meanwhile; one
    shuffle, by recording, serves all steps. An event without a time comes last, and who has none after that isn't open.
    """
    ends = F.explode(F.array(F.struct(F.col("from_ms").alias("moment"), F.lit(1).alias("d")), F.struct(F.col("to_ms").alias("moment"), F.lit(-1).alias("d")))).alias("e")
    events = segments.select(key, "speaker", ends).select(key, "speaker", "e.*").repartition(key).groupBy(key, "speaker", "moment").agg(F.sum("d").alias("d"))
    own = W.partitionBy(key, "speaker").orderBy(F.col("moment").asc_nulls_last())
    open_ = F.sum("d").over(own)
    states = events.select(key, "moment", "speaker", F.when((open_ > 0) & F.lead("moment").over(own).isNotNull() & F.col(key).isNotNull(), open_).otherwise(F.lit(0)).alias("open"))
    kinds = {f.name: f.dataType for f in states.schema}
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("moment", kinds["moment"]), T.StructField("next_moment", kinds["moment"]), T.StructField("active", T.LongType()), T.StructField("speakers", T.ArrayType(kinds["speaker"]))])
    return states.sortWithinPartitions(key, F.col("moment").asc_nulls_last()).mapInArrow(_sweep, out)


def _sweep(batches):
    """Rows of timeline from states (recording, moment, speaker, open segments from then on) in the order of recording and moment."""
    at, held, active, names = None, {}, 0, []
    for b in batches:
        rows = []
        for k, moment, speaker, n in zip(*(c.to_pylist() for c in b.columns)):
            if (k, moment) != at:
                if at:
                    same = at[0] == k
                    rows.append((*at, moment if same else None, active, names))
                    if not same:
                        held, active, names = {}, 0, []
                at = (k, moment)
            before = held.get(speaker, 0)
            active += n - before
            if n:
                held[speaker] = n
            elif before:
                del held[speaker]
            if (n > 0) != (before > 0):
                names = sorted(x for x in held if x is not None)
        kinds = b.schema.types[0], b.schema.types[1], b.schema.types[1], pa.int64(), pa.list_(b.schema.types[2])
        make = lambda rows, kinds=kinds: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["k", "moment", "next_moment", "active", "speakers"])
        yield make(rows)
    if at:
        yield make([(*at, None, active, names)])


def rebase(segments: DataFrame, chunk_ms: int) -> DataFrame:
    """Times local to a chunk (column chunk_no) made global."""
    offset = F.col("chunk_no") * chunk_ms
    return segments.withColumn("from_ms", F.col("from_ms") + offset).withColumn("to_ms", F.col("to_ms") + offset)


def chunks(media: DataFrame, chunk_ms: int) -> DataFrame:
    """media_id, chunk_no, from_ms, to_ms of the equal slices of recordings with a duration_ms; the last one may be shorter."""
    numbered = media.select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration_ms") / chunk_ms).cast("int"), F.lit(1)) - 1)).alias("chunk_no"))
    return numbered.select("media_id", "chunk_no", (F.col("chunk_no") * F.lit(chunk_ms).cast("long")).alias("from_ms"), F.least((F.col("chunk_no") + 1) * F.lit(chunk_ms).cast("long"), "duration_ms").alias("to_ms"))


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """'from to speaker' lines to columns speaker, from_s, to_s, null where a line lacks them; other columns stay."""
    parts = F.split(F.trim(column), " ")
    return lines.withColumn("from_s", F.get(parts, F.lit(0)).try_cast("double")).withColumn("to_s", F.get(parts, F.lit(1)).try_cast("double")).withColumn("speaker", F.get(parts, F.lit(2))).drop(column)
