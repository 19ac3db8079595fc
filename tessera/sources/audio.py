"""WAV audio: decoding, media information, slicing. Other formats come through a decoder of the user's."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

INFO = "path string, ok boolean, duration double, sample_rate int, channels int, max_dbfs double, rms int, error string"


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels float32 samples in [-1, 1], sample rate)."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        data = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        data = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        data -= (data >> 23) << 24
    else:
        data = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.int64)
    return (data.reshape(-1, channels) / float(1 << (8 * width - 1))).astype(np.float32), rate


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(1)


def info(content: bytes) -> dict:
    samples, rate = decode(content)
    with wave.open(io.BytesIO(content)) as w:
        full = float(1 << (8 * w.getsampwidth() - 1))
    peak = float(np.abs(samples).max()) if samples.size else 0.0
    rms = math.sqrt(float((samples.astype(np.float64) ** 2).mean())) if samples.size else 0.0
    return {"duration": len(samples) / rate, "sample_rate": rate, "channels": samples.shape[1], "max_dbfs": 20 * math.log10(peak) if peak else float("-inf"), "rms": int(rms * full)}


def encode(samples: np.ndarray, rate: int) -> bytes:
    """Float samples to a 16-bit WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def media_info(files: DataFrame) -> DataFrame:
    """Information on every file of (path, content); one that can't be decoded has ok = false and an error."""

    def run(batches):
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    rows.append({"path": path, "ok": True, **info(bytes(content)), "error": None})
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append({"path": path, "ok": False, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "ok", "duration", "sample_rate", "channels", "max_dbfs", "rms", "error"]).astype({"sample_rate": "Int32", "channels": "Int32", "rms": "Int32"})

    return files.select("path", "content").mapInPandas(run, INFO)


def slices(files: DataFrame, seconds: float) -> DataFrame:
    """path, chunk_no and content: mono WAV slices of so many seconds."""

    def run(batches):
        for p in batches:
            for path, content in zip(p["path"], p["content"]):
                samples, rate = decode(bytes(content))
                m, step = mono(samples)[:, None], max(1, int(rate * seconds))
                yield pd.DataFrame([{"path": path, "chunk_no": k, "content": encode(m[s : s + step], rate)} for k, s in enumerate(range(0, max(len(m), 1), step))])

    return files.select("path", "content").mapInPandas(run, "path string, chunk_no int, content binary")


def gather(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """path, speaker and content: each speaker's segments of a recording, end to end. segments: path, speaker, from_ms, to_ms."""

    def run(key, s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(a):
            return pd.DataFrame({"path": [], "speaker": [], "content": []})
        samples, rate = decode(bytes(a["content"].iloc[0]))
        m = mono(samples)[:, None]
        out = []
        for speaker, part in s.sort_values(["from_ms", "to_ms"]).groupby("speaker"):
            pieces = [m[int(f * rate / 1000) : int(t * rate / 1000)] for f, t in zip(part["from_ms"], part["to_ms"])]
            out.append({"path": key[0], "speaker": speaker, "content": encode(np.concatenate(pieces), rate)})
        return pd.DataFrame(out)

    return segments.groupBy("path").cogroup(audio.groupBy("path")).applyInPandas(run, "path string, speaker string, content binary")
