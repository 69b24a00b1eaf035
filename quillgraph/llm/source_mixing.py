"""Mixing sources to target weights by entropy balancing.

Document rates w are the closest to 1 each (in relative entropy, none above `cap`) for which every
source has its target of words: sum(w * size) = target. The dual is convex with one multiplier a
source, and its solution tilts the rates exponentially: w = min(cap, exp(lambda * size / mean)).

1. Sizes are counted once, into a narrow table in the shared folder; one aggregate gives each
   source's size, and the driver shares out the targets (sources are a catalogue: it holds a few numbers of each).
2. Newton's method on the dual: each step is one distributed pass over (source, size, documents)
   cells and returns gradient and curvature of each source; a bracket guards every step, as the
   dual has kinks where rates reach the cap.
3. Rates become copies: floor(rate), and one more for the documents of a cell whose hash is below the cell's mark. All
   documents of a cell have one rate; marks are set cell by cell, from a source's longest documents to its
   shortest, and what a cell's rounding leaves is made good by the next ones. Copies are thus the floor or the
   ceiling of the rate, reruns agree, and a source misses its target by about half of its shortest document, if it has
   documents enough. A task reads a source's cells one after another, in order, and holds one at a time; d different
   sizes need more than d * d / 2 words, so there are few.

Defined results: a null text has size 0 and is taken once, for 0 words; a null source is a source of its own,
last in order; the hash is that of doc_id and text, so rows that agree in both get the same copies. A source
without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_rows, discard, stored


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Targets by weight that add up to the sizes; none is above cap * size: what is over goes to the
    others by weight until none is above."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        for i in over or free:
            targets[i] = cap * sizes[i] if over else weights[i] * unit
        if not over:
            break
        free -= set(over)
        left -= sum(targets[i] for i in over)
    return targets


@dataclass
class Balance:
    """One source: what it has, what it shall have, its multiplier and the bracket around it."""

    source: str | None
    size: int
    mean: float
    target: float = 0.0
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = field(default=False)

    def step(self, words: float, slope: float, tolerance: float) -> None:
        """One guarded Newton step, from the words that the present tilt gives and their slope."""
        gap = self.target - words
        if abs(gap) <= tolerance * max(1.0, self.target):
            self.done = True
            return
        self.low, self.high = (self.tilt, self.high) if gap > 0 else (self.low, self.tilt)
        to = self.tilt + gap / slope if slope > 0 else math.inf * gap
        if not self.low < to < self.high or abs(to - self.tilt) > 4 * (1 + abs(self.tilt)):
            ends = math.isfinite(self.low), math.isfinite(self.high)
            to = (self.low + self.high) / 2 if all(ends) else self.tilt + math.copysign(1 + abs(self.tilt), gap)
        self.tilt = to


#: Documents of a cell are told apart by this many values of their hash when it is rounded.
BINS = 64


def _table(spark: SparkSession, balances: list[Balance], broadcast_sources: int) -> DataFrame:
    """The balances as a table; a plan joins it by broadcast as long as it has few rows."""
    columns = {"s": pa.array([b.source for b in balances], pa.string()), "total": pa.array([b.size for b in balances], pa.int64()), "done": pa.array([b.done for b in balances], pa.bool_())}
    columns |= {c: pa.array([getattr(b, c) for b in balances], pa.float64()) for c in ("mean", "target", "tilt")}
    table = spark.createDataFrame(pa.table(columns))
    return F.broadcast(table) if len(balances) <= broadcast_sources else table


def _rate(cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean"))))


def bin_of(doc_id: Column, text: Column) -> Column:
    """0 to BINS - 1, from a hash of the id and the text."""
    return F.pmod(F.xxhash64(F.lit("copies"), doc_id, text), F.lit(BINS)).cast("int")


def _sized(docs: DataFrame) -> list[Column]:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), bin_of(doc_id, text).alias("bin")]


def round_cells(cells: Iterator[tuple[str | None, int, float, list[tuple[int, int]]]]) -> Iterator[tuple[str | None, int, float, int, int]]:
    """(source, size, rate, [(bin, documents)]) of each cell, a source's together and its longest first. For each:
    source, size, rate, copies of every document, and the mark: documents with a smaller bin get one more."""
    now, owed = object(), 0.0
    for source, size, rate, bins in cells:
        if source != now:
            now, owed = source, 0.0
        whole = math.floor(rate)
        part, n = rate - whole, sum(k for _, k in bins)
        wanted = part * n + (owed / size if size else 0.0)
        taken, mark = 0, 0
        for number, k in sorted(bins) if part else ():
            if abs(taken + k - wanted) >= abs(taken - wanted):
                break
            taken, mark = taken + k, number + 1
        owed += (part * n - taken) * size
        yield source, size, rate, whole, mark


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cells():
        for batch in batches:
            for source, size, rate, bins in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "rate", "bins")), strict=True):
                yield source, size, rate, [(x["bin"], x["k"]) for x in bins]

    types, names = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32()], ["s", "of_size", "rate", "whole", "mark"]
    held: list[tuple] = []
    for row in round_cells(cells()):
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


@dataclass
class Mixture:
    """The fitted balance of every source, the table of sizes that it was fitted on, and the cells' marks."""

    narrow: DataFrame
    balances: list[Balance]
    marks: DataFrame  # s, of_size, rate, whole, mark
    few_marks: bool
    broadcast_sources: int

    def taken(self, rows: DataFrame) -> DataFrame:
        """`rows` (source, size, bin and others) with source_size, target, rate, copies and taken."""
        marks = F.broadcast(self.marks) if self.few_marks else self.marks
        out = rows.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("of_size"))).drop("s")
        out = out.join(_table(rows.sparkSession, self.balances, self.broadcast_sources), F.col("source").eqNullSafe(F.col("s")))
        copies = F.col("whole") + (F.col("bin") < F.col("mark")).cast("int")
        out = out.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("total").alias("source_size"), "target", "rate", copies.alias("copies"))
        return out.withColumn("taken", F.col("copies") * F.col("size"))


def fit_mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, tolerance: float = 1e-4, newton_steps: int = 40, broadcast_sources: int = 100_000, broadcast_cells: int = 200_000) -> Mixture:
    """Sources in code point order (null last) weigh `weights`, repeating."""
    spark = docs.sparkSession
    narrow = stored(docs.select(*_sized(docs)))
    bins = stored(narrow.groupBy("source", "size", "bin").agg(F.count("*").alias("k")))
    cells = stored(bins.groupBy("source", "size").agg(F.sum("k").alias("n"), F.collect_list(F.struct("bin", "k")).alias("bins")))
    found = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    balances = [Balance(r["source"], r["total"], max(1.0, r["total"] / r["n"])) for r in found]
    for b, target in zip(balances, share_out([b.size for b in balances], [weights[i % len(weights)] for i in range(len(balances))], cap), strict=True):
        b.target = target
        b.done = b.size == 0
        if b.target >= cap * b.size * (1 - 1e-9):
            b.tilt, b.done = 1e9, True  # every rate is at the cap
    by_source = {b.source: b for b in balances}

    def tilted() -> DataFrame:
        return cells.join(_table(spark, balances, broadcast_sources), F.col("source").eqNullSafe(F.col("s")))

    for _ in range(newton_steps):
        if all(b.done for b in balances):
            break
        rate, words = _rate(cap), F.col("n") * F.col("size")
        slope = F.when(rate < cap, rate * F.col("size") / F.col("mean")).otherwise(0.0)
        for row in tilted().filter("not done").groupBy("source").agg(F.sum(words * rate).alias("words"), F.sum(words * slope).alias("slope")).collect():
            by_source[row["source"]].step(row["words"], row["slope"], tolerance)

    in_order = tilted().select("source", "size", _rate(cap).alias("rate"), "bins").repartition("source").sortWithinPartitions("source", F.desc("size"))
    marks = stored(in_order.mapInArrow(arrow_rows(_marks), "s string, of_size long, rate double, whole int, mark int"))
    discard(bins, cells)
    return Mixture(narrow, balances, marks, marks.count() <= broadcast_cells, broadcast_sources)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row of `docs`."""
    mixture = fit_mixture(docs, **options)
    return mixture.taken(mixture.narrow).drop("bin")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them."""
    mixture = fit_mixture(docs, **options)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_sized(docs))
    taken = mixture.taken(packed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
