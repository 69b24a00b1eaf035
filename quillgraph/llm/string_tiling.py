"""Benchmark decontamination by greedy string tiling.

Texts become words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text). Running Karp-Rabin hashes
of every `seed` consecutive words of a document are looked up among those of the test items; shared
seeds grow to maximal matches, and tiling marks the longest match that overlaps no marked word of
either side, again and again, until none of `seed` words or more is left. An item's coverage is the
share of its words that are marked; a document is contaminated by every item of which it covers
`least_coverage` or more, in whatever order the passages stand.

Items are a query set: they are read in blocks of at most `block_bytes` bytes, each sent to all
tasks (its size is proven by the block), and every block meets all documents.

Defined results: items and documents without words (null, empty) match nothing; items of fewer than `least_words` words
contaminate nothing, as they stand in texts by chance; an item that is let in with fewer words than `seed` is one seed as
a whole; repeated items (same text) each match; rows of documents with
the same doc_id are judged one by one; a null doc_id or item_id is reported as null.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_rows, document_texts, running_hashes, small_batches, word_hashes

_BLANKS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))
def word_row(text: str | None) -> bytes:
    """The text's words with blanks between them."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKS) if text else b""


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The running hash of every `size` consecutive words."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return running_hashes(words, at, at + size)


def tile(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of the tiles, longest first; at
    equal lengths the first in the item, then in the document."""
    runs, done = [], set()
    n, m = len(item), len(doc)
    for i, j in sorted(seeds):
        if (i, j) in done:
            continue
        a, b = i, j
        length = 0
        while a + length < n and b + length < m and item[a + length] == doc[b + length]:
            length += 1
        done.update((i + x, j + x) for x in range(max(1, length - least + 1)))
        if length >= least:
            runs.append((-length, a, b))
    heapq.heapify(runs)
    item_marked, doc_marked, tiles = np.zeros(n, bool), {}, []
    while runs:
        size, a, b = heapq.heappop(runs)
        size = -size
        free = [not item_marked[a + x] and b + x not in doc_marked for x in range(size)]
        if all(free):
            item_marked[a : a + size] = True
            doc_marked.update((b + x, True) for x in range(size))
            tiles.append((a, b, size))
            continue
        start = None
        for x, ok in enumerate([*free, False]):
            if ok and start is None:
                start = x
            elif not ok and start is not None:
                if x - start >= least:
                    heapq.heappush(runs, (start - x, a + start, b + start))
                start = None
    return tiles


@dataclass
class TestBlock:
    """Items with their word hashes and, by seed length, their sorted seeds."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # hash, item, place, bitmap

    BITS = 1 << 20

    @classmethod
    def over(cls, items: list[tuple[object, bytes]], seed: int) -> TestBlock:
        ids, words = [i for i, _ in items], list(word_hashes(w for _, w in items))
        found = defaultdict(list)
        for k, own in enumerate(words):
            size = min(seed, len(own))
            if size:
                h = window_hashes(own, size)
                found[size].append((h, np.full(len(h), k), np.arange(len(h))))
        seeds = {}
        for size, parts in found.items():
            h, k, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(cls.BITS, bool)
            bitmap[h & np.uint64(cls.BITS - 1)] = True
            seeds[size] = h[order], k[order], at[order], bitmap
        return cls(ids, words, seeds)

    def matches(self, doc: np.ndarray, least_coverage: float) -> list[tuple[object, float, int, list[tuple[int, int, int]]]]:
        """(item id, coverage, item's words, tiles) of the items that the document covers."""
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, (hashes, items, places, bitmap) in self.seeds.items():
            own = window_hashes(doc, size)
            maybe = np.flatnonzero(bitmap[own & np.uint64(self.BITS - 1)])
            if not len(maybe):
                continue
            low = np.searchsorted(hashes, own[maybe], side="left")
            high = np.searchsorted(hashes, own[maybe], side="right")
            for j, a, z in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                for x in range(a, z):
                    pairs[int(items[x])].append((int(places[x]), j))
        out = []
        for k, seeds in pairs.items():
            item = self.words[k]
            size = min(len(item), self._seed_of(item))
            # an upper bound first: words that any seed touches
            touched = np.zeros(len(item), bool)
            for i in {i for i, _ in seeds}:
                touched[i : i + size] = True
            if touched.mean() < least_coverage:
                continue
            tiles = tile(item, doc, seeds, size)
            coverage = sum(t[2] for t in tiles) / len(item)
            if coverage >= least_coverage:
                out.append((self.ids[k], coverage, len(item), tiles))
        return out

    def _seed_of(self, item: np.ndarray) -> int:
        return max(s for s in self.seeds if s <= len(item))


def test_blocks(benchmark: DataFrame, seed: int, block_bytes: int, least_words: int) -> Iterator[TestBlock]:
    items, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        words = word_row(row["text"])
        if len(words.split()) < least_words:
            continue
        if size + len(words) > block_bytes and items:
            yield TestBlock.over(items, seed)
            items, size = [], 0
        items.append((row["item_id"], words))
        size += len(words)
    yield TestBlock.over(items, seed)


def _words_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return word_hashes(word_row(t.as_py()) for t in batch.column("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_coverage: float = 0.6, seed: int = 5, block_bytes: int = 4_000_000, least_words: int = 5) -> DataFrame:
    """doc_id, item_id, coverage, item_words, n_tiles, first_word (of the document) of every contaminated
    document and the items that it covers."""
    spark, out = docs.sparkSession, None
    for block in test_blocks(benchmark, seed, block_bytes, least_words):
        carried = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for doc_id, words in zip(batch.column("doc_id").to_pylist(), _words_of(batch), strict=True):
                    for item, coverage, size, tiles in carried.value.matches(words, least_coverage):
                        found.append((doc_id, item, coverage, size, len(tiles), min(t[1] for t in tiles)))
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "item_words", "n_tiles", "first_word"])

        part = document_texts(docs).mapInArrow(arrow_rows(rows), "doc_id long, item_id long, coverage double, item_words long, n_tiles long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_coverage: float = 0.6, seed: int = 5, block_bytes: int = 4_000_000, least_words: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, that no item contaminates."""
    spark, out = docs.sparkSession, docs
    small_batches(spark)
    for block in test_blocks(benchmark, seed, block_bytes, least_words):
        carried = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not carried.value.matches(words, least_coverage) for words in _words_of(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(arrow_rows(rows), docs.schema)
    return out
