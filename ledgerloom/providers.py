"""Model calls behind a small interface, and a deterministic stand-in.

A provider turns prompts to texts. `generated` sends each distinct prompt once: prompts are made distinct before the
call and joined back, so a repeated prompt costs nothing (the call cache of a batch engine).
"""

from __future__ import annotations

import hashlib
import json
import time
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StandIn:
    """Answers that depend on the prompt's hash alone, and embeddings by hashed words."""

    def __init__(self, width: int = 384):
        self.width = width

    def generate(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"answer": hashlib.sha256(p.encode()).hexdigest()[:12], "length": len(p)}) for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


def patient(call, prompts: list[str], tries: int = 3, wait: float = 2.0):
    """Call again after wait, 2 wait, ... seconds; the last error is raised."""
    for k in range(tries):
        try:
            return call(prompts)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def generated(rows: DataFrame, provider: Provider, prompt: str = "prompt", name: str = "answer", at_once: int = 4) -> DataFrame:
    """`rows` with the provider's answer; at most `at_once` tasks call it."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({prompt: f[prompt], name: patient(provider.generate, list(f[prompt]))})

    asked = rows.select(prompt).where(F.col(prompt).isNotNull()).distinct().repartition(at_once)
    return rows.join(asked.mapInPandas(run, f"`{prompt}` string, `{name}` string"), prompt, "left")


def embedded(rows: DataFrame, provider: Provider, text: str = "text", name: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def vector(s: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(list(s)))

    return rows.withColumn(name, vector(F.coalesce(text, F.lit(""))))
