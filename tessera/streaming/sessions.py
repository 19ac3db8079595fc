"""Streams, beyond what is asked of batch: windows with late data, sessions, utterances as words arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Counts and sums by type in event-time windows; what is later than ``late`` is dropped and its state freed."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row per user and session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def utterances(labelled: DataFrame) -> DataFrame:
    """Finished utterances of a stream of labelled words: media_id, speakers, start_ms, end_ms, text.

    Words of a recording must arrive in order; the open utterance is the only state. It ends when the speakers change, and at
    the end of a recording (a word that is null).
    """

    def step(key, batches, state: GroupState):
        speakers, start, end, text = state.get if state.exists else (None, None, None, None)
        for p in batches:
            out = []
            for r in p.sort_values(["turn", "pos"]).itertuples():
                label = " & ".join(r.speakers) or "<Unknown>"
                if speakers is not None and (r.word is None or label != speakers):
                    out.append((key[0], speakers, start, end, text))
                    speakers = None
                if r.word is None:
                    continue
                if speakers is None:
                    speakers, start, end, text = label, r.start_ms, r.end_ms, r.word
                else:
                    end, text = r.end_ms, f"{text} {r.word}"
            yield pd.DataFrame(out, columns=["media_id", "speaker", "start_ms", "end_ms", "text"])
        if speakers is None:
            if state.exists:
                state.remove()
        else:
            state.update((speakers, int(start), int(end), text))

    return labelled.groupBy("media_id").applyInPandasWithState(step, "media_id long, speaker string, start_ms long, end_ms long, text string", "speaker string, start_ms long, end_ms long, text string", "append", GroupStateTimeout.NoTimeout)
