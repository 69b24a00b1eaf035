"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document's set is its distinct word n-grams (64-bit hashes). Documents with equal sets form one
node. Two nodes link if den * intersection >= num * union. The product of the incidence matrix with its
transpose is computed only where it can matter:

1. Columns are ordered: n-grams that are frequent among the smallest-hash prefixes of all documents come
   last, the others by hash. A node of size n enters only its first n - ceil(num*n/den) + 1 columns;
   linked nodes share one of these at least. Columns with a single node are dropped.
2. Columns of up to `block` nodes are multiplied out and overlap counts accumulated by pair. If two nodes
   of sizes a and b link, they share alpha = ceil(num*(a+b)/(num+den)) n-grams, and so at least
   alpha + 1 - ceil(num*max(a,b)/den) columns of their prefixes. Pairs that can't reach this bound,
   even if all their longer columns were shared, are discarded.
3. Longer columns (a large group of near copies, or a passage that many share) are not multiplied out.
   The nodes that have one are few. All n-grams of these are counted among them and ordered again, the rarest
   first, and steps 1 and 2 are repeated in this order: copies with many edits of their own then have few long columns.
   Each long column is first matched against a few pivots, the nodes with the largest shares of such columns; members
   whose links join them to one component need no further comparison among themselves. What is left, members outside
   a column's largest component against the others, is multiplied out, but only for sizes at which a member has enough
   long columns to reach the bound by these alone, where both share as many, and where parity sketches of their
   whole sets don't prove that they differ in too many n-grams.
4. Pairs that remain are verified on whole sets; links give connected components. Of the pairs of step 2,
   each node's best is verified first, then those that still lie between components.

No link between different components is lost, so components are exact (up to collisions of 64-bit hashes).

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words than an
n-gram is one n-gram as a whole; a null text, or one without words, has an empty set, links with
nothing and is its own component. Rows with the same doc_id are rows of their own with equal component if
equal or linked; a null doc_id is smaller than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_rows, discard, document_texts, shingle_hashes, small_broadcasts, stored, word_hashes

NO_ID = -(2**63)


def kept_size(n, num: int, den: int):
    """ceil(num * n / den)"""
    return (num * n + den - 1) // den


def ngram_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes."""
    texts = ((t.as_py() or b"").lower() for t in batch.column("text").cast(pa.binary()))
    for words in word_hashes(texts):
        grams = shingle_hashes(words, size)
        if not len(grams) and len(words):
            grams = shingle_hashes(words, len(words)) ^ np.uint64(len(words))
        grams.sort()
        yield grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) > 1 else grams


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63


#: 64-bit words of a parity sketch.
PARITY = 16


def parity_of(grams: np.ndarray) -> list[int]:
    """For each of 1024 cells, whether an odd number of the set's hashes fall into it. Two sets differ in
    at least as many n-grams as their sketches differ in bits."""
    odd = np.bincount((grams >> np.uint64(7) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _node_rows(size: int, num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes, parities = [], [], [], []
            for grams in ngram_sets(batch, size):
                nodes.append(node_of(grams))
                sizes.append(len(grams))
                parities.append(parity_of(grams))
                prefixes.append(grams[: len(grams) - kept_size(len(grams), num, den) + 1].tobytes() if len(grams) else b"")
            given = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, given), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(parities, pa.list_(pa.int64()))], [*given, "node", "n", "prefix", "parity"])

    return rows


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = dict(zip(batch.column("node").to_pylist(), batch.column("prefix").to_pylist(), strict=True))
        columns, n = np.unique(np.frombuffer(b"".join(own.values()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(n.astype(np.int64))], ["col", "df"])


def _packed_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's columns as one value: a row each would take the driver a hundred bytes and more."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("col").to_numpy().tobytes()], pa.binary())], ["cols"])


class Frequent:
    """Membership in a sorted array, most misses answered by a bitmap."""

    BITS = 1 << 22

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.bitmap = np.zeros(self.BITS, bool)
        self.bitmap[self.values & np.uint64(self.BITS - 1)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.bitmap[x & np.uint64(self.BITS - 1)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == x[maybe]
        return out


def _prefix(grams: np.ndarray, late: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first columns of a node: its n-grams by hash, those that are marked `late` after the others."""
    p = len(grams) - kept_size(len(grams), num, den) + 1
    order = grams[~late][:p]
    return order if len(order) == p else np.concatenate([order, grams[late][: p - len(order)]])


def _moved_counts(size: int, num: int, den: int, carried):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns that come into prefixes because frequent ones have moved back."""
        for batch in batches:
            found = {}
            for grams in ngram_sets(batch, size):
                late = carried.value.has(grams)
                if len(grams) and late[: len(grams) - kept_size(len(grams), num, den) + 1].any():
                    order = _prefix(grams, late, num, den)
                    found[node_of(grams)] = order[~carried.value.has(order)]
            if found:
                columns, n = np.unique(np.concatenate(list(found.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(columns.view(np.int64)), pa.array(n.astype(np.int64))], ["col", "df"])

    return rows


def _incidence_rows(size: int, num: int, den: int, carried):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, nodes, sizes, seen = [], [], [], set()
            for grams in ngram_sets(batch, size):
                node = node_of(grams)
                if not len(grams) or node in seen:
                    continue
                seen.add(node)
                order = _prefix(grams, carried.value.has(grams), num, den)
                columns.append(order)
                nodes.append(np.full(len(order), node, np.int64))
                sizes.append(np.full(len(order), len(grams), np.int32))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], ["col", "node", "n"])

    return rows


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(ngram_sets(batch, size))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    return rows


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each n-gram of a set."""
    for batch in batches:
        sets = [np.frombuffer(s.as_py(), np.int64) for s in batch.column("grams")]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        if sizes.sum():
            nodes = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(sizes, sizes))], ["col", "node", "n"])


def _linked_rows(num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _alpha(a: Column, b: Column, num: int, den: int) -> Column:
    """n-grams that linked nodes of sizes a and b share at least."""
    return F.floor((num * (a + b) + (num + den - 1)) / (num + den))


def _bound(a: Column, b: Column, num: int, den: int) -> Column:
    """Prefix columns that linked nodes of sizes a and b share at least."""
    return _alpha(a, b, num, den) + 1 - F.floor((num * F.greatest(a, b) + (den - 1)) / den)


#: Classes of size between two sizes that just fit.
CLASSES = 8


class JaccardJoin:
    """The join over one table; see the module's text."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, block: int = 64, most_frequent: int = 2_000_000, broadcast_rows: int = 500_000, rounds: int = 2, pivots: int = 8, keyed: bool = False):
        if not 0 < num <= den or den >= 2**20:
            raise ValueError("the threshold must be num / den, above 0 and at most 1")
        self.spark, self.size, self.num, self.den = docs.sparkSession, size, num, den
        small_broadcasts(self.spark)
        self.block, self.most_frequent, self.broadcast_rows, self.rounds, self.pivots = block, most_frequent, broadcast_rows, rounds, pivots
        self.texts = document_texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        if keyed:
            self.texts = self.texts.withColumn("key", text_key(F.col("text")))
        self.rows = stored(self.texts.mapInArrow(arrow_rows(_node_rows(size, num, den)), f"doc_id long, {'key long, ' if keyed else ''}node long, n long, prefix binary, parity array<long>"))

    def _over(self, counts: DataFrame, room: int) -> np.ndarray:
        """The columns of more than `block` / 2 prefixes, or of more if they would be over `room`."""
        least = self.block // 2
        counted = stored(counts.groupBy("col").agg(F.sum("df").alias("df")).filter(F.col("df") > least))
        while (found := counted.filter(F.col("df") > least)).count() > room:
            least *= 2
        packed = found.select("col").mapInArrow(arrow_rows(_packed_columns), "cols binary").collect()  # 8 bytes a column
        columns = np.frombuffer(b"".join(r["cols"] for r in packed), np.uint64)
        discard(counted)
        return columns

    def _frequent(self):
        """The columns to be ordered last, on all tasks; at most `most_frequent`. When they move back, others
        come into prefixes, of which some are frequent too: so again, a few times."""
        found = self._over(self.rows.select("node", "prefix").mapInArrow(arrow_rows(_prefix_counts), "col long, df long"), self.most_frequent)
        carried = self.spark.sparkContext.broadcast(Frequent(found))
        for _ in range(self.rounds if len(found) else 0):
            counts = self.texts.mapInArrow(arrow_rows(_moved_counts(self.size, self.num, self.den, carried)), "col long, df long")
            more = self._over(counts, self.most_frequent - len(found))
            if not len(more):
                break
            found = np.concatenate([found, more])
            carried.destroy()
            carried = self.spark.sparkContext.broadcast(Frequent(found))
        return carried

    def _incidence(self) -> DataFrame:
        """(col, long, node, n, h): prefix columns of two nodes or more; h: the node's long columns."""
        carried = self._frequent()
        found = self.texts.mapInArrow(arrow_rows(_incidence_rows(self.size, self.num, self.den, carried)), "col long, node long, n int").distinct()
        found = stored(found.select("col", "node", "n"))
        carried.destroy()
        counted = found.groupBy("col").agg(F.count("*").alias("df")).filter("df >= 2")
        kept = stored(found.join(counted, "col").select("col", (F.col("df") > self.block).alias("long"), "node", F.col("n").cast("long").alias("n")))
        h = kept.filter("long").groupBy("node").agg(F.count("*").alias("h"))
        rows = stored(kept.join(h, "node", "left").select("col", "long", "node", "n", F.coalesce("h", F.lit(0)).alias("h")))
        discard(found, kept)
        return rows

    def _pairs(self, left: DataFrame, right: DataFrame, condition: Column, long: bool = False) -> DataFrame:
        """Overlap counts of pairs that meet in a column: (a, b, c), a < b, under the bound. `long`: the
        pair meets in long columns only. It must share `bound` of each side's h, so the first that it
        shares is, in column order, among the first h - bound + 1 of both."""
        x, y = left.alias("x"), right.alias("y")
        bound, least_h = _bound(F.col("x.n"), F.col("y.n"), self.num, self.den), F.least("x.h", "y.h")
        on = (F.col("x.col") == F.col("y.col")) & _sizes_fit(F.col("x.n"), F.col("y.n"), self.num, self.den) & condition
        if long:
            # a column's members are dealt by classes of size; sizes that fit lie in the same or in CLASSES + 1 neighbouring
            # ones. A row goes to those with a size at which its h reaches the bound, which falls from n on both sides
            wide = math.log(self.den / self.num) * 1.0001 / CLASSES
            own = lambda n: F.floor(F.ln(n) / F.lit(wide)) if wide else n
            to = F.explode(F.sequence(own(F.col("n")) - (CLASSES + 1), own(F.col("n")) + (CLASSES + 1))) if wide else own(F.col("n"))
            ends = (F.greatest(F.floor(F.exp(F.col("class") * wide)) - 1, F.lit(1)), F.ceil(F.exp((F.col("class") + 1) * wide)) + 1) if wide else (F.col("n"), F.col("n"))
            # rounding lifts an end by one above a size within at most
            reaches = F.least(*(_bound(F.col("n"), end, self.num, self.den) for end in ends)) - 1 <= F.col("h") - F.col("r") + 1
            # few rows with much work each: dealt to all tasks, which Spark doesn't merge
            n_tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            x = left.withColumn("class", to).filter(reaches).repartition(n_tasks, "node").alias("x")
            y = right.repartition(n_tasks, "node").withColumn("class", own(F.col("n"))).alias("y")
            on &= F.col("x.class") == F.col("y.class")
            early = (F.col("x.r") <= F.col("x.h") - bound + 1) & (F.col("y.r") <= F.col("y.h") - bound + 1)
            apart = sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(PARITY)), F.lit(0))
            most = F.col("x.n") + F.col("y.n") - 2 * _alpha(F.col("x.n"), F.col("y.n"), self.num, self.den)
            shared = F.array_intersect("x.cols", "y.cols")
            met = x.join(y, on & early & (apart <= most) & (F.size(shared) >= bound) & (F.array_min(shared) == F.col("x.col")))
            return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.lit(1).alias("c")).distinct()
        met = x.join(y, on)
        counted = met.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), bound.alias("bound"), least_h.alias("h")).agg(F.count("*").alias("c"))
        return counted.filter(F.col("c") + F.col("h") >= F.col("bound")).select("a", "b", "c")

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """(node, grams): whole sets of `nodes`, and of others whose rows have the same doc_id."""
        first = self.rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        wanted = stored(nodes.join(first, "node").select("doc_id", "node"))
        few = wanted.count() <= self.broadcast_rows
        ids = wanted.select("doc_id").distinct()
        picked = self.texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        sets = stored(picked.mapInArrow(arrow_rows(_set_rows(self.size)), "node long, grams binary").dropDuplicates(["node"]))
        discard(wanted)
        return sets

    def _rare_first(self, nodes: DataFrame) -> DataFrame:
        """(col, long, node, n, h): prefix columns that two of `nodes` or more have, in the order of how many of `nodes`
        have them; h: the node's long columns."""
        sets = self._sets(nodes)
        cells = stored(sets.join(nodes, "node", "left_semi").mapInArrow(arrow_rows(_cell_rows), "col long, node long, n long"))
        counted = stored(cells.groupBy("col").agg(F.count("*").alias("df")).filter("df >= 2"))
        shared = stored(cells.join(counted, "col"))
        own = Window.partitionBy("node")  # at most a node's n-grams
        # n-grams of no other node come before those that are shared
        ranked = shared.withColumn("r", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "col")))
        kept = ranked.filter(F.col("r") <= F.col("n") - F.floor((self.num * F.col("n") + (self.den - 1)) / self.den) + 1)
        kept = kept.select("col", (F.col("df") > self.block).alias("long"), "node", "n")
        rows = stored(kept.withColumn("h", F.sum(F.col("long").cast("long")).over(own)))
        discard(sets, cells, counted, shared)
        return rows

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        sets = self._sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        with_b = pairs.select("a", "b").join(sets.withColumnRenamed("grams", "grams_b"), F.col("b") == F.col("node")).drop("node")
        with_both = with_b.join(sets.withColumnRenamed("grams", "grams_a"), F.col("a") == F.col("node")).select("a", "b", "grams_a", "grams_b")
        linked = stored(with_both.mapInArrow(arrow_rows(_linked_rows(self.num, self.den)), "a long, b long"))
        discard(sets)
        return linked

    def components(self) -> DataFrame:
        """(node, root) of the nodes that have a link."""
        rows = self._incidence()
        light = rows.filter(~F.col("long"))
        once = F.col("x.node") < F.col("y.node")
        # linked nodes that share long columns only have one both: they are found in the second order
        nodes = stored(rows.filter("long").select("node").distinct())
        again = self._rare_first(nodes)
        light_again, long = again.filter(~F.col("long")), again.filter("long")
        pairs = stored(self._pairs(light, light, once).unionByName(self._pairs(light_again, light_again, once)))
        share = F.col("h") / (F.col("n") - F.floor((self.num * F.col("n") + (self.den - 1)) / self.den) + 1)
        pivots = long.groupBy("col", F.pmod("node", F.lit(self.pivots)).alias("deal")).agg(F.max(F.struct(share.alias("share"), -F.col("n"), "node", "n", "h")).alias("p")).select("col", F.col("p.h").alias("h"), F.col("p.node").alias("node"), F.col("p.n").alias("n"))
        stars = self._pairs(long, pivots, F.col("x.node") != F.col("y.node"))

        best = pairs.select("a", "b", "c").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
        best = best.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = self._verified(stored(best.unionByName(stars.select("a", "b")).distinct()))
        roots = connected(links)

        between = _between(pairs, roots)
        if not between.isEmpty():
            links = stored(links.unionByName(self._verified(between)))
            roots = connected(links)

        placed = long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = Window.partitionBy("node").orderBy("col")  # at most a node's prefix
        placed = placed.withColumns({"r": F.row_number().over(own), "cols": F.collect_list("col").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        sketches = self.rows.groupBy("node").agg(F.first("parity").alias("parity"))
        placed = stored(placed.join(sketches, "node"))
        # stored, as a join of two tables is one whose hot keys Spark can split
        largest = stored(placed.groupBy("col", "root").agg(F.count("*").alias("m")).groupBy("col").agg(F.max_by("root", F.struct("m", "root")).alias("main")))
        marked = stored(placed.join(largest, "col"))
        left = self._pairs(marked.filter("root <> main"), marked, (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))), long=True)
        left = stored(left)
        if not left.isEmpty():
            roots = connected(links.unionByName(self._verified(left)))
        discard(rows, nodes, again, pairs, placed, largest, marked, left)
        return roots

    def result(self) -> DataFrame:
        """doc_id, n_ngrams, component_id of every row."""
        roots = self.components()
        first = self.rows.groupBy("node").agg(F.min("doc_id").alias("first"))
        placed = stored(first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        least = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")))
        # joins of stored tables: Spark can split the rows of a large component, or of many equal texts
        named = stored(placed.join(least, "root").select("node", "component_id"))
        discard(placed, least)
        out = self.rows.select("doc_id", "node", "n").join(named, "node")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        known = lambda c: F.when(c != NO_ID, c)
        return out.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_ngrams"), known(component).alias("component_id"))

    def representatives(self) -> DataFrame:
        """kept_id, kept_key, kept_times of the rows that stand for their component: the smallest (doc_id, key) and how
        many rows of the component have it. Rows without words stand for themselves, whatever their number."""
        placed = self.rows.filter("n > 0").join(self.components(), "node", "left").withColumn("root", F.coalesce("root", "node"))
        times = placed.groupBy("root", "doc_id", "key").agg(F.count("*").alias("times"))
        first = times.groupBy("root").agg(F.min(F.struct("doc_id", "key", "times")).alias("first")).select("first.*")
        alone = self.rows.filter("n = 0").select("doc_id", "key", F.lit(1).cast("long").alias("times")).distinct()
        return stored(first.unionByName(alone).toDF("kept_id", "kept_key", "kept_times"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes lie in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return stored(both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").distinct())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `links` (a, b); root is a component's least node. Each round takes the
    least root among neighbours and then the root's own root, so long chains halve. Roots are looked up once
    each; every join is one of stored tables, so that Spark can split the rows of a large component."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        heard = stored(edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard")))
        near = stored(roots.join(heard, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")))
        discard(heard, roots)
        if near.filter("root <> old").isEmpty():  # neighbours agree
            discard(edges)
            return near.select("node", "root")
        up = near.select(F.col("root").alias("up")).distinct().join(near.select("node", F.col("root").alias("up_root")), F.col("up") == F.col("node"))
        hops = stored(up.filter("up_root < up").select("up", "up_root"))
        roots = near.select("node", "root")
        if not hops.isEmpty():
            roots = stored(near.join(hops, F.col("root") == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root")))
            discard(near)
        discard(hops)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """doc_id, n_ngrams and component_id (the smallest doc_id reachable by links) of every row."""
    return JaccardJoin(docs, size, num, den, **options).result()


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows with the same doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def first_of_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """One row of `docs`, with all its columns, for each component: one with its smallest doc_id. Components are
    told apart by their texts, so rows of several may share a doc_id, or have none."""
    found = JaccardJoin(docs, size, num, den, keyed=True, **options).representatives()
    # the columns of `docs` travel as one, so that none can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    packed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own_id"), text_key(F.col("text").cast("string")).alias("own_key"))
    met = packed.join(found, (F.col("own_id") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")))
    if found.filter("kept_times > 1").isEmpty():
        return met.select("row.*")
    once = met.filter("kept_times = 1").select("row")
    again = met.filter("kept_times > 1").groupBy("kept_id", "kept_key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
