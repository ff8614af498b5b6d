"""Chunks of texts: fixed stride, and cut at sentence ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of the overlap with the next.
SIZE, OVERLAP = 1000, 200


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks that start every size - overlap characters; the last may be the end of the one before; empty texts give none."""
    stride = size - overlap
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / stride).cast("int") - 1))
    return docs.where(F.length("text") > 0).select("doc_id", "text", at.alias("chunk")).select("doc_id", "chunk", F.substr("text", F.col("chunk") * stride + 1, F.lit(size)).alias("content"))


def cut_points(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of chunks: the end is the first sentence mark within the window's last `overlap` characters, if any."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            marks = [p for p in (text.find(m, end - overlap, end) for m in ".!?") if p >= 0]
            end = min(marks) + 1 if marks else end
        out.append((start, min(end, len(text))))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def sentence_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk, start, end, content, total; each start depends on the cut before, so texts are walked one by one."""

    def run(frames):
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                parts = [(s, e, text[s:e].strip()) for s, e in cut_points(text or "", size, overlap)]
                parts = [p for p in parts if p[2]]
                rows += [(doc, i, s, e, c, len(parts)) for i, (s, e, c) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "content", "total"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, start int, end int, content string, total int")
