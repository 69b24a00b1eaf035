"""Embedding providers: a protocol, two HTTP services and an offline one for tests."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Texts of one request.
BATCH = 100


class Embedder(Protocol):
    dimensions: int
    model_name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def vectors(self, chunks: DataFrame) -> DataFrame: ...


class _Batched:
    """vectors(): texts travel in Arrow batches and are embedded BATCH at a time on the executors."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def vectors(self, chunks: DataFrame) -> DataFrame:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), BATCH):
                    part = pdf.iloc[at : at + BATCH]
                    yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": self.embed(part["content"].tolist())})

        return chunks.select("chunk_id", "content").mapInPandas(rows, "chunk_id string, embedding array<float>")


class HashEmbedder(_Batched):
    """Deterministic, offline: signed hashed words, unit length."""

    model_name = "hashed-words"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def _post(url: str, headers: dict[str, str], body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:  # raises for any status but 2xx
        return json.load(answer)


class OpenAIEmbedder(_Batched):
    dimensions, model_name = 1536, "text-embedding-3-small"

    def __init__(self, key: str, base_url: str = ""):
        self.key, self.base_url = key, base_url or "https://api.openai.com"

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = _post(f"{self.base_url}/v1/embeddings", {"Authorization": f"Bearer {self.key}"}, {"input": texts, "model": self.model_name})
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]


class GoogleEmbedder(_Batched):
    dimensions, model_name = 768, "text-embedding-004"

    def __init__(self, key: str, base_url: str = ""):
        self.key, self.base_url = key, base_url or "https://generativelanguage.googleapis.com"

    def embed(self, texts: list[str]) -> list[list[float]]:
        requests = [{"model": f"models/{self.model_name}", "content": {"parts": [{"text": t}]}} for t in texts]
        answer = _post(f"{self.base_url}/v1beta/models/{self.model_name}:batchEmbedContents", {"x-goog-api-key": self.key}, {"requests": requests})
        return [x["values"] for x in answer["embeddings"]]


def chosen(provider: str = "", key: str = "", base_url: str = "") -> Embedder | None:
    """By configuration; a key in the environment overrides the configured one, no key gives none."""
    key = os.environ.get("QUILLGRAPH_EMBED_KEY") or key
    if not key:
        return None
    return GoogleEmbedder(key, base_url) if provider == "google" else OpenAIEmbedder(key, base_url)
