"""Overlapping chunks of about 512 tokens.

Paragraphs (or, where they are too long, their sentences) are the units. A chunk takes units while
its estimate stays within the target; the next begins as many units back as make up the overlap. The fold
goes back and forth within a document, so it runs in Arrow batches; documents are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.arrow import arrow_rows, small_batches

#: Target and overlap in tokens, a token being four bytes.
TARGET, OVERLAP = 512, 64

_SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s)")


def tokens_in(n_bytes: int) -> int:
    return -(-n_bytes // 4)


def units_of(text: str) -> list[str]:
    out = []
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if tokens_in(len(paragraph.encode())) <= TARGET:
            out.append(paragraph)
        else:
            out.extend(s.strip() for s in _SENTENCE_END.split(paragraph))
    return [u for u in out if u]


def spans_of(sizes: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[first, end) unit of each chunk, from the units' bytes; units are joined by one blank."""
    ends = [0, *accumulate(sizes)]
    spans, first = [], 0
    while first < len(sizes):
        end = first + 1
        while end < len(sizes) and tokens_in(ends[end + 1] - ends[first] + end - first) <= target:
            end += 1
        spans.append((first, end))
        back, shared = end, 0
        while back > first and shared < overlap:
            back -= 1
            shared += tokens_in(sizes[back])
        first = back if back > first else end
    return spans


def each_chunk(text: str | None) -> Iterator[str]:
    units = units_of(text or "")
    return (" ".join(units[a:z]) for a, z in spans_of([len(u.encode()) for u in units]))


def chunk_texts(text: str | None) -> list[str]:
    return list(each_chunk(text))


#: Bytes of chunks that leave a worker together.
TOGETHER = 1 << 20


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], ["path", "namespace", "chunk_index", "content"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text by text, so that a worker holds one and about TOGETHER of chunks beside the batch it was handed."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        held = 0
        for path, namespace, text in zip(*(batch.column(c) for c in ("path", "namespace", "text")), strict=True):
            for index, content in enumerate(each_chunk(text.as_py())):
                for values, x in zip(out, (path.as_py(), namespace.as_py(), index, content), strict=True):
                    values.append(x)
                held += len(content)
                if held >= TOGETHER:
                    yield _batch(out)
                    out, held = ([], [], [], []), 0
        if out[0]:
            yield _batch(out)


def chunked(texts: DataFrame) -> DataFrame:
    """(path, namespace, text) to chunks; chunk_id is path#index."""
    from quillgraph.functions.text import token_estimate

    small_batches(texts.sparkSession)
    rows = texts.select("path", "namespace", "text").mapInArrow(arrow_rows(_rows), "path string, namespace string, chunk_index int, content string")
    return rows.select(F.concat_ws("#", "path", "chunk_index").alias("chunk_id"), "path", "namespace", "chunk_index", "content", token_estimate(F.col("content")).alias("token_count"))
