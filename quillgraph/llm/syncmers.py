"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text's units are its words cut into pieces of at most `unit_chars` code points, so a text without
white space has units as well. A k-mer is a run of K units; its inner substrings are the runs of S
units inside it. A k-mer is a closed syncmer if the smallest hash of its inner substrings is
the first or the last one. Whether a k-mer is chosen depends on its own units alone, so
equal passages give equal anchors wherever they stand. Of any K - S k-mers in a row one is chosen, so 2K - S - 1
units in a row that two texts share give a common anchor. Short texts have less in common than that, so units and
2-mers (closed syncmers with k = s) are anchors too: all in texts of up to FADE units, then fewer and fewer by their
hash, none from 2 * FADE on, so that texts of similar length have anchors of the same kinds. The fingerprint lists
the chosen k-mers' 32-bit hashes (8 hex digits each) in text order.

Likeness of two fingerprints is positional: the anchors that both have are put in either's order of first
appearance; `kept` is 1 plus the number of neighbours in the one order that are neighbours in the other (0 without
common anchors); 2 * kept / (a + b) over the distinct hashes. Passages in another order thus count less than the same
passages in place.

Defined results: a null text counts as empty; a text without units has one anchor, the hash of none. Equal texts
always have equal fingerprints. Rows with the same doc_id are ordered by a hash of their text; a null
doc_id is the last in descending order. A table of one row has itself as next document.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import document_texts

#: Units of a k-mer and of its inner substrings, code points of a unit at most.
K, S, UNIT_CHARS = 9, 2, 8
#: By size of the short k-mers: the units of a text up to which all are anchors; from twice as many on none is.
FADE = {1: K, 2: 2 * K - S - 1}


def units(text: Column, unit_chars: int = UNIT_CHARS) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\S{{1,{unit_chars}}}"), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at: int, h: int>>: unit number and hash of each closed syncmer, in order."""
    inner = k - s + 1

    def chosen(h: Column) -> Column:
        # hashes of the runs of s units: s is small, so each is a hash over s neighbours
        n = F.size(h)

        def runs(hashes: Column) -> Column:
            last = F.size(hashes) - s + 1
            return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.lit(0), last)), lambda _, i: F.hash(*(F.get(hashes, i + j) for j in range(s))))

        def pick(m: Column) -> Column:
            def edge(i: Column) -> Column:
                # by index: a slice would copy the whole array for every k-mer
                hashes = [F.get(m, i + j) for j in range(inner)]
                return F.least(hashes[0], hashes[-1]) <= F.least(*hashes)

            starts = F.filter(F.sequence(F.lit(0), n - k), edge)
            return F.transform(starts, lambda i: F.struct(i.alias("at"), F.hash(*(F.get(h, i + j) for j in range(k))).alias("h")))

        none = F.array()

        def short(size: int, fade: int) -> Column:
            starts = F.when((n >= size) & (n < 2 * fade), F.sequence(F.lit(0), n - size)).otherwise(none.cast("array<int>"))
            every = F.transform(starts, lambda i: F.struct(i.alias("at"), F.hash(*(F.get(h, i + j) for j in range(size))).alias("h")))
            return F.filter(every, lambda x: F.pmod(x["h"], F.lit(fade)) < 2 * fade - n)

        whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(h).alias("h")))
        found = F.when(n >= k, let(runs(h), pick)).otherwise(none.cast("array<struct<at: int, h: int>>"))
        both = F.when(n < 2 * max(FADE.values()), F.sort_array(F.concat(found, *(short(size, fade) for size, fade in FADE.items())))).otherwise(found)
        return let(both, lambda some: F.when(F.size(some) > 0, some).otherwise(whole))

    return let(F.transform(units(F.coalesce(text, F.lit(""))), lambda u: F.xxhash64(u)), chosen)


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda's argument is not computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_of(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(F.pmod(h.cast("long"), F.lit(2**32))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    def neighbours(x: Column) -> Column:
        after = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
        return F.transform(after, lambda h, i: F.get(x, i).cast("long") * F.lit(2**32) + F.pmod(h.cast("long"), F.lit(2**32)))

    in_place = F.array_intersect(let(F.array_intersect(a, b), neighbours), let(F.array_intersect(b, a), neighbours))
    kept = F.size(in_place) + F.arrays_overlap(a, b).cast("int")
    return 2.0 * kept / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, anchors (unit numbers and hashes) and fingerprint of every row of `docs`."""
    found = document_texts(docs).select("doc_id", anchors(F.col("text")).alias("anchors"))
    return found.withColumn("fingerprint", F.lower(hex_of(F.col("anchors.h"))))


# ------------------------------------------------------------------ next documents


def _bucket(bounds: Column, value: Column, n: int) -> Column:
    """How many of the n sorted bounds are below `value`, by halving."""
    steps = max(1, math.ceil(math.log2(n + 1)))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & F.coalesce(F.get(bounds, mid) < value, F.lit(False))
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def _numbers(values: list[int | None]) -> Column:
    """A constant array of whole numbers, however many: Spark reads the text once, when it plans."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = 250, most_buckets: int = 1 << 20, measured: int = 1 << 14) -> DataFrame:
    """`rows` (with doc_id and text) and next_<c> of each column: the next row in descending doc_id, and the
    first after the last. Rows are dealt by range of doc_id, in one shuffle; each range's first row is dealt a
    second time, to the end of the range before it. Up to `measured` ends of ranges are quantiles, more lie evenly between
    these. What the driver holds is two numbers a range; beyond `most_buckets` ranges they get longer, and Spark
    sorts them on disk."""
    count = rows.count()
    n = max(1, min(most_buckets, math.ceil(count / bucket_rows)))
    bounds: list[int] = []
    if n > 1:
        marks = min(n, measured)
        points = [i / marks for i in range(1, marks)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", points, 4 * marks).alias("bounds")).first()["bounds"] or []))
        parts = math.ceil(n / marks)
        between = {lo + (hi - lo) * i // parts for lo, hi in zip(bounds, bounds[1:], strict=False) for i in range(1, parts)}
        bounds = sorted(between.union(bounds))
    bucket = _bucket(_numbers(bounds), F.col("doc_id"), len(bounds)) if bounds else F.lit(0)
    heads = dict(rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id")).collect())
    present = sorted(heads, reverse=True)
    before = {b: present[k - 1] for k, b in enumerate(present)}
    every = range(len(bounds) + 1)
    head, end_of = _numbers([heads.get(b) for b in every]), _numbers([before.get(b) for b in every])
    first = F.col("doc_id").eqNullSafe(F.get(head, F.col("bucket")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))
    again = F.struct(F.get(end_of, F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("tail"))
    places = F.when(first, F.array(own, again)).otherwise(F.array(own))
    dealt = rows.withColumn("bucket", bucket).withColumn("place", F.explode(places)).withColumn("tie", F.xxhash64("text"))
    w = Window.partitionBy("place.bucket").orderBy("place.tail", F.col("doc_id").desc_nulls_last(), "tie")
    follows = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return follows.filter("place.tail = 0").select(*rows.columns, *(f"next_{c}" for c in columns))


def edited_text(text: Column, n_chars: Column, next_text: Column) -> Column:
    """The last third (rounded down) of the code points replaced by as many of the next text's first."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - third).cast("int")), F.substring(next_text, F.lit(1), third))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = document_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = texts.withColumn("hashes", anchors(F.col("text"))["h"])
    both = with_next(marked, ["text", "hashes"])
    n_chars = F.length("text").cast("long")
    rows = both.select("doc_id", n_chars.alias("n_chars"), "hashes", "next_hashes", edited_text(F.col("text"), n_chars, F.col("next_text")).alias("edited"))
    rows = rows.withColumn("edited_hashes", anchors(F.col("edited"))["h"])
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.lower(hex_of(F.col("hashes"))).alias("fingerprint"),
        F.lower(hex_of(F.col("edited_hashes"))).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
