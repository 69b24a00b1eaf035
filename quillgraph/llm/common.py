"""What the corpus operators share: the shared folder, hashing of words, lower-casing of A-Z."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.arrow import arrow_rows as arrow_rows
from quillgraph.functions.arrow import small_batches

#: The white space of every contract here: [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests on one machine) a temporary folder takes its place where that setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir() + "/quillgraph-shared"
    return f"{root.rstrip('/')}/quillgraph-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends there and
    a lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `stored` that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quillgraph-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def small_broadcasts(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bounds the tables that Spark broadcasts by its own choice. It goes by the size of their files; on the driver, which
    collects, hashes and sends them, they are many times that, several at once. Stays for the session, like `small_batches`."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        given = spark.conf.get(key) if key == "spark.sql.autoBroadcastJoinThreshold" else spark.conf.get(key, "-1")
        if not given.startswith("-") and spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) > size:
            spark.conf.set(key, str(size))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def document_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text only, so that no other column of `docs` can clash; batches of texts are small."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 2**64))):
                    steps = np.full(size, np.uint64(base))
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


powers = _Powers()


def running_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of each range [start, end) of 64-bit values: sum of value * base**offset modulo
    2**64, all from one array of running sums; mixed at the end."""
    up, down = powers.of(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


#: A 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
#: Byte strings of this size go through numpy at once.
PIECE = 1 << 18


def _piece_words(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte string; words are split at [\\x20\\x09-\\x0D]."""
    codes = np.frombuffer(piece, np.uint8)
    edge = np.ones(len(codes) + 2, bool)
    edge[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts = np.flatnonzero(edge[:-1] & ~edge[1:])
    ends = np.flatnonzero(~edge[:-1] & edge[1:])
    return starts, running_hashes(BYTE_VALUES[codes], starts, ends)


def cut_pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about PIECE bytes, cut before white space."""
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text) and (m := _SPACE.search(text, to)):
            to = m.start()
        elif to < len(text):
            to = len(text)
        yield text[at:to]
        at = to


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order. Short texts go through numpy together."""
    held: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        starts, hashes = _piece_words(b"\n".join(held))
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        yield from np.split(hashes, np.searchsorted(starts, np.cumsum(lengths)[:-1]))

    for text in texts:
        if len(text) > PIECE:
            if held:
                yield from together()
                held, size = [], 0
            yield np.concatenate([_piece_words(p)[1] for p in cut_pieces(text)])
            continue
        if size + len(text) > PIECE and held:
            yield from together()
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield from together()


_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, from the words' hashes; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out ^= words[i : i + n]
            out *= _MULTIPLY[i % 4]
            out ^= out >> np.uint64(29)
        out *= _MULTIPLY[1]
        out ^= out >> np.uint64(32)
    return out
