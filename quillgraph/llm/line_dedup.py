"""Line dedup by a sharded minimal perfect hash.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. A key
of at least `min_chars` code points that stands in at least `min_docs` documents keeps its lines
only in the document with the largest id that holds it.

1. Each document yields the 128-bit hashes of its distinct long keys. A hash aggregate counts
   documents and takes the largest id, so a key in a third of all rows is summed before it moves.
2. Keys of two documents or more go to shards of about `shard_keys` keys. A shard is a minimal
   perfect hash (levels of bit arrays with ranks) over one half of the hash; its slots index
   arrays of fingerprints (the other half), counts and largest ids.
3. Documents send packed hashes to the shards, not lines. A shard that expects more than its
   share of probes, as it holds a frequent line, is copied and its probes are dealt over the copies (the driver
   holds a number for each shard that is). The streams are sorted so that a shard's arrays come just before its
   probes: a task holds one shard at a time.
4. The shards' answers (keys that a document loses) meet the texts again by doc_id.

Defined results: a null or empty text is one empty line; rows with the same doc_id count as
one document when documents are counted, and all rows with the largest id keep the line; a null doc_id is an id
that is smaller than any other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE_BYTES, arrow_rows, document_texts, stored

NO_ID = -(2**63)
KEY = np.dtype([("hi", "<i8"), ("lo", "<i8")])


# ------------------------------------------------------------------ minimal perfect hash


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x % np.uint64(size)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1. At each level the keys that are alone in their slot get
    its bit, the others go on to the next level; a key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of bool
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def over(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = _slots(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has it (never for a key it was built over)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _slots(keys[left], level, len(bits)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]] + self.before[level]
            left = left[~hit]
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpacked(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<i8", n, 8), 8 + 8 * n, []
        for size in sizes.tolist():
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)


class Shard:
    """The arrays of one shard: by slot a fingerprint, a document count and the largest id."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray):
        self.index, self.prints, self.counts, self.largest = index, prints, counts, largest

    @classmethod
    def over(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> Shard:
        # two keys that agree in `hi` (about n*n/2**65 pairs) keep their lines apart by `lo`: the
        # index is over the mixed halves, of which the pair has two different values
        index = PerfectHash.over(mixed(hi, lo))
        at = index(mixed(hi, lo))
        n = len(hi)
        out = cls(index, np.zeros(n, "<i8"), np.zeros(n, "<u4"), np.zeros(n, "<i8"))
        out.prints[at], out.counts[at], out.largest[at] = lo, np.minimum(counts, 2**32 - 1), largest
        return out

    def lost(self, keys: np.ndarray, doc_ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes name a key that its document loses."""
        at = self.index(mixed(keys["hi"], keys["lo"]))
        known = at >= 0
        at = np.where(known, at, 0)
        if not len(self.prints):
            return known
        return known & (self.prints[at] == keys["lo"]) & (self.counts[at] >= min_docs) & (self.largest[at] != doc_ids)

    def packed(self) -> bytes:
        body = self.index.packed()
        return np.array([len(body), len(self.prints)], "<i8").tobytes() + body + self.prints.tobytes() + self.counts.tobytes() + self.largest.tobytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> Shard:
        size, n = np.frombuffer(blob, "<i8", 2).tolist()
        at = 16 + size
        return cls(
            PerfectHash.unpacked(blob[16:at]),
            np.frombuffer(blob, "<i8", n, at),
            np.frombuffer(blob, "<u4", n, at + 8 * n),
            np.frombuffer(blob, "<i8", n, at + 12 * n),
        )


def mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hi.astype(np.uint64) ^ (lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


# ------------------------------------------------------------------ lines


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    texts = batch.column("text").cast(pa.binary())
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
        yield doc_id, text.as_py() or b""


def _keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """The 128-bit hashes of a text's distinct long keys."""
    if len(text) < min_chars:
        return set()
    keys = {line_key(x) for x in text.split(b"\n") if len(x) >= min_chars}
    return {xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, min_chars)}


def _count_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in _documents(batch):
                keys = _keys_of(text, min_chars)
                found += keys
                ids += [doc_id] * len(keys)
            keys = np.frombuffer(b"".join(found), KEY)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys["hi"])), pa.array(np.ascontiguousarray(keys["lo"])), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    return rows


def _probe_rows(min_chars: int, n_shards: int, copies: dict[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in _documents(batch):
                found = _keys_of(text, min_chars)
                if not found:
                    continue
                keys = np.frombuffer(b"".join(found), KEY)
                shard = keys["hi"] % n_shards
                order = np.argsort(shard, kind="stable")
                keys, shard = keys[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                deal = xxhash.xxh32_intdigest(str(doc_id).encode())
                for s, part in zip(shard[np.concatenate([[0], cuts])].tolist(), np.split(keys, cuts), strict=True):
                    out[0].append(s)
                    out[1].append(deal % copies.get(s, 1))
                    out[2].append(NO_ID if doc_id is None else doc_id)
                    out[3].append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["shard", "replica", "doc_id", "packed"])

    return rows


def _build_shards(pdf):
    import pandas as pd

    shard = Shard.over(*(pdf[c].to_numpy() for c in ("hi", "lo", "n_docs", "largest")))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [shard.packed()]})


def _answers(min_docs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (shard, replica, kind): a shard's blob (kind 0) precedes its probes (kind 1)."""
        at, shard = None, None
        for batch in batches:
            ids, packed = [], []
            columns = [batch.column(c).to_pylist() for c in ("shard", "replica", "kind", "doc_id", "packed")]
            for (s, r, kind), group in groupby(zip(*columns, strict=True), key=lambda x: x[:3]):
                probes = list(group)
                if kind == 0:
                    at, shard = (s, r), Shard.unpacked(probes[0][4])
                elif at == (s, r):  # the probes of all documents at once
                    sizes = [len(x[4]) // KEY.itemsize for x in probes]
                    keys = np.frombuffer(b"".join(x[4] for x in probes), KEY)
                    lost = shard.lost(keys, np.repeat(np.array([x[3] for x in probes], np.int64), sizes), min_docs)
                    starts = np.cumsum([0, *sizes])
                    for k in np.flatnonzero(np.add.reduceat(lost, starts[:-1])).tolist():
                        own = slice(starts[k], starts[k + 1])
                        ids.append(probes[k][3])
                        packed.append(keys[own][lost[own]].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["lost_id", "packed"])

    return rows


def _drop_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept, sums = [], [], [], []
            for (_, text), packed in zip(_documents(batch), batch.column("lost").to_pylist(), strict=True):
                parts = text.split(b"\n")
                lines.append(len(parts))
                if packed:
                    blob = b"".join(packed)
                    lost = {blob[i : i + 16] for i in range(0, len(blob), 16)}
                    parts = [x for x in parts if len(x) < min_chars or xxhash.xxh3_128_digest(line_key(x)) not in lost]
                    text = b"\n".join(parts)
                dropped.append(lines[-1] - len(parts))
                kept.append(text)
                sums.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    return rows


def _no_text(rows):
    def digests(batches):
        for batch in rows(batches):
            yield batch.select(["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return digests


# ------------------------------------------------------------------ operator


def repeated_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(hi, lo, n_docs, largest) of the long keys that stand in two documents or more."""
    texts = document_texts(docs)
    rows = texts.mapInArrow(arrow_rows(_count_rows(min_chars)), "hi long, lo long, doc_id long")
    if not texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.distinct()
    counted = rows.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))
    return counted.filter("n_docs >= 2").select("hi", "lo", "n_docs", F.coalesce("largest", F.lit(NO_ID)).alias("largest"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 4_000, replica_probes: int = 200_000, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text (if `with_text`) and kept_sha256 of every row of `docs`."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    texts = document_texts(docs)
    keys = stored(repeated_keys(docs, min_chars))
    n_keys = keys.count()
    n_shards = max(1, math.ceil(n_keys / shard_keys))
    shard = F.pmod("hi", F.lit(n_shards)).alias("shard")
    load = keys.groupBy(shard).agg(F.sum("n_docs").alias("probes")).filter(F.col("probes") > replica_probes)
    copies = {r["shard"]: -(-r["probes"] // replica_probes) for r in load.collect()}

    blobs = keys.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shards, "shard long, blob binary")
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(int(v)) for pair in copies.items() for v in pair)), F.col("shard").cast("int")), F.lit(1)) if copies else F.lit(1)
    shards = blobs.select("shard", F.explode(F.sequence(F.lit(0), times - 1)).alias("replica"), F.lit(0).alias("kind"), F.lit(NO_ID).alias("doc_id"), F.col("blob").alias("packed"))
    probes = texts.mapInArrow(arrow_rows(_probe_rows(min_chars, n_shards, copies)), "shard long, replica int, doc_id long, packed binary")
    # as many tasks as shards and copies, up to the number of shuffle partitions: small ones aren't merged
    n_tasks = min(n_shards + sum(copies.values()), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = shards.unionByName(probes.withColumn("kind", F.lit(1))).repartition(n_tasks, "shard", "replica").sortWithinPartitions("shard", "replica", "kind")
    answers = met.mapInArrow(arrow_rows(_answers(min_docs)), "lost_id long, packed binary").groupBy("lost_id").agg(F.collect_list("packed").alias("lost"))
    joined = texts.join(answers, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("lost_id"), "left").select("doc_id", "text", "lost")
    rows = _drop_rows(min_chars)
    if with_text:
        return joined.mapInArrow(arrow_rows(rows), "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string")
    return joined.mapInArrow(arrow_rows(_no_text(rows)), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
