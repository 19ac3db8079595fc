"""Where models come in. Each kind of tool is a function over DataFrames; the built-in ones are deterministic stand-ins.

The stand-ins don't give the results of the models they stand for; they make every plan runnable and testable.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import text


class Tool(Protocol):
    def __call__(self, df: DataFrame, **settings) -> DataFrame: ...


#: kind -> name -> tool
TOOLS: dict[str, dict[str, Tool]] = {k: {} for k in ("transcriber", "diarizer", "embedder", "splitter", "entities", "language", "summary")}


def tool(kind: str, name: str):
    def add(f: Tool) -> Tool:
        TOOLS[kind][name] = f
        return f

    return add


def get(kind: str, name: str) -> Tool:
    if name not in TOOLS[kind]:
        raise ValueError(f"unknown {kind}: {name}")
    return TOOLS[kind][name]


def retried(load: Callable, attempts: int = 3, pause: float = 1.0, errors: tuple = (Exception,)):
    """load() again after an error, with a pause between attempts but none after the last, whose error is raised."""
    for k in range(attempts):
        try:
            return load()
        except errors:
            if k == attempts - 1:
                raise
            time.sleep(pause)


@tool("splitter", "rules")
def split_rules(df: DataFrame, keys=("book_id", "pos"), column: str = "text") -> DataFrame:
    return text.sentence_table(df, list(keys), column)


@tool("entities", "rules")
def entity_rules(df: DataFrame, keys=("book_id", "pos"), labels=None) -> DataFrame:
    patterns = text.ENTITIES if labels is None else {k: v for k, v in text.ENTITIES.items() if k in labels}
    return text.entities(df, list(keys), patterns)


@tool("language", "votes")
def language_votes(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("language", text.language(F.col(column)))


@tool("summary", "heads")
def summary_heads(df: DataFrame, key: str = "media_id") -> DataFrame:
    return text.refine(df, key)


def messages(system: str, prompt: str, metadata: dict[str, str] | None = None) -> str:
    """A prompt from its parts; metadata become lines of 'key: value'."""
    lines = "\n".join(f"{k}: {v}" for k, v in (metadata or {}).items())
    return "\n\n".join(x for x in (system, lines, prompt) if x)
