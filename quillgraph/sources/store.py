"""The index on disk: segments of Parquet tables below one folder, named by numbered manifests.

A change costs what has changed: it writes a new segment (the new rows, and which paths they replace or remove) and
then a manifest with the next number, which lists the segments that hold. A table is read as the segments' rows less
those whose path a later segment touches. After `most_segments` changes all is written to one segment. Readers of an
older manifest are not disturbed; a failed write changes nothing; of two writers at once the second fails, as its
manifest's number is taken.

Tables: notes, chunks, vectors, and the full-text index of the chunks: postings (by a hash of the term, so that a
query reads its terms' files) and sizes. How many chunks there are, and tokens in them, stands in the manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.functions.chunks import chunked
from quillgraph.operators import fts

_KEPT = ("namespace", "title", "body", "tags", "links_out", "checksum", "last_verified", "last_indexed")


def merged_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: a note whose checksum is the stored one stays as it is; others take all new columns but
    consolidated_at, which a re-index keeps. Notes that `new` lacks stay."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.path") == F.col("n.path"), "full")
    take = F.col("n.path").isNotNull() & ~F.coalesce(F.col("o.checksum") == F.col("n.checksum"), F.lit(False))
    columns = [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _KEPT]
    return joined.select(F.coalesce("o.path", "n.path").alias("path"), *columns, F.col("o.consolidated_at").alias("consolidated_at"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose checksum is new: only these are parsed, chunked and embedded again."""
    return new.join(old.select("path", "checksum"), ["path", "checksum"], "left_anti").select("path")


def stale_paths(old: DataFrame, visited: DataFrame) -> DataFrame:
    return old.select("path").join(visited.select("path"), "path", "left_anti")


def marked(notes: DataFrame, paths: DataFrame, at: int | None) -> DataFrame:
    """consolidated_at of `paths` set to `at` (None takes the mark away)."""
    hit = paths.select("path").distinct().withColumn("hit", F.lit(True))
    value = F.when(F.coalesce("hit", F.lit(False)), F.lit(at).cast("long")).otherwise(F.col("consolidated_at"))
    return notes.join(hit, "path", "left").select(*[c for c in notes.columns if c != "consolidated_at"], value.alias("consolidated_at"))


@dataclass
class Changes:
    updated: int
    total: int
    removed: int


@dataclass
class Manifest:
    number: int
    chunks: int
    tokens: int
    segments: list[dict]  # id, tables, touched: the tables of which it replaces paths


_TABLES = ("notes", "chunks", "vectors", "postings", "sizes")
_SCHEMAS = {"notes": model.NOTES, "chunks": model.CHUNKS, "vectors": model.VECTORS, "postings": fts.POSTINGS, "sizes": "chunk_id string, path string, size int"}


def path_of_chunk(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, r"(?s)^(.*)#\d+$", 1)


class Store:
    def __init__(self, spark: SparkSession, folder: str, most_segments: int = 16):
        self.spark, self.folder, self.most_segments = spark, folder.rstrip("/"), most_segments

    # ---- files, by Hadoop's file system, so any store that Spark reads will do

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest | None:
        fs = self._files()
        found = fs.globStatus(self._path("MANIFEST-*"))
        names = sorted(f.getPath().getName() for f in (found or ()))
        if not names:
            return None
        stream = fs.open(self._path(names[-1]))
        try:
            content = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(content))

    def _publish(self, manifest: Manifest) -> None:
        fs, tmp = self._files(), self._path(f"writing-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        to = self._path(f"MANIFEST-{manifest.number:012d}")
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise RuntimeError("another writer has changed the index")

    def exists(self) -> bool:
        return self.manifest() is not None

    def _stored(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{segment['id']}/{name}")

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        out, later = None, None
        for segment in reversed(manifest.segments if manifest else []):
            if name in segment["tables"]:
                rows = self._stored(segment, name)
                if later is not None:
                    path = path_of_chunk(F.col("chunk_id")) if name == "vectors" else F.col("path")
                    gone = later.distinct().withColumnRenamed("path", "__gone")
                    rows = rows.join(gone, path == F.col("__gone"), "left_anti")
                out = rows if out is None else out.unionByName(rows)
            if name in segment["touched"]:
                touched = self.spark.read.schema("path string").parquet(f"{self.folder}/{segment['id']}/touched")
                later = touched if later is None else later.unionByName(touched)
        return self.spark.createDataFrame([], _SCHEMAS[name]) if out is None else out

    def _append(self, before: Manifest | None, tables: dict[str, DataFrame], touched: DataFrame | None, of: tuple[str, ...], chunks: int, tokens: int) -> None:
        """A new segment with `tables`, which replaces what the tables `of` have of the `touched` paths."""
        segment = {"id": f"s-{uuid.uuid4().hex}", "tables": list(tables), "touched": list(of) if touched is not None else []}
        for name, rows in tables.items():
            writer = rows.sortWithinPartitions("term").write.partitionBy("bucket") if name == "postings" else rows.write
            writer.parquet(f"{self.folder}/{segment['id']}/{name}")
        if touched is not None:
            touched.select("path").write.parquet(f"{self.folder}/{segment['id']}/touched")
        after = Manifest((before.number if before else 0) + 1, chunks, tokens, [*(before.segments if before else []), segment])
        if len(after.segments) > self.most_segments:
            one = {"id": f"s-{uuid.uuid4().hex}", "tables": list(_TABLES), "touched": []}
            for name in _TABLES:
                rows = self.read(name, after)
                writer = rows.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket") if name == "postings" else rows.write
                writer.parquet(f"{self.folder}/{one['id']}/{name}")
            after.segments = [one]
        self._publish(after)

    def vacuum(self) -> None:
        """Deletes segments and manifests that the newest manifest doesn't need."""
        fs, now = self._files(), self.manifest()
        kept = {s["id"] for s in now.segments} | {f"MANIFEST-{now.number:012d}"} if now else set()
        for pattern in ("s-*", "MANIFEST-*"):
            for f in fs.globStatus(self._path(pattern)) or ():
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)

    # ---- changes

    def _sums(self, paths: DataFrame, manifest: Manifest | None) -> tuple[int, int]:
        """Chunks and tokens that the index has of some paths."""
        if manifest is None:
            return 0, 0
        row = self.read("sizes", manifest).join(paths.select("path"), "path", "left_semi").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        return row[0], row[1]

    def index(self, parsed: DataFrame, embedder=None, visited: DataFrame | None = None) -> Changes:
        """Takes parsed notes (with full_body); notes that `visited` (default: parsed) lacks are removed,
        with their chunks and vectors. Nothing is written if nothing has changed."""
        now = self.manifest()
        notes = self.read("notes", now)
        parsed = parsed.cache()
        held = [parsed]
        try:
            visited = parsed if visited is None else visited
            changed = changed_paths(notes, parsed).cache()
            gone = stale_paths(notes, visited).cache()
            held += [changed, gone]
            result = Changes(changed.count(), visited.count(), gone.count())
            if not result.updated and not result.removed and now is not None:
                return result
            new = parsed.join(changed, "path", "left_semi")
            fresh = chunked(new.select("path", "namespace", F.col("full_body").alias("text"))).cache()
            entries = fts.postings(fresh, "chunk_id", "content", "path", alone=True)  # read once, when written
            sizes = fts.sizes(fresh, "chunk_id", "content", "path").cache()
            held += [fresh, sizes]
            tables = {"notes": merged_notes(notes.join(changed, "path", "left_semi"), new.drop("full_body")), "chunks": fresh, "postings": entries, "sizes": sizes}
            tables["vectors"] = embedder.vectors(fresh) if embedder is not None else self.spark.createDataFrame([], model.VECTORS)
            touched = changed.unionByName(gone)
            old_chunks, old_tokens = self._sums(touched, now)
            row = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            chunks, tokens = (now.chunks, now.tokens) if now else (0, 0)
            self._append(now, tables, touched if now else None, _TABLES, chunks - old_chunks + row[0], tokens - old_tokens + row[1])
            return result
        finally:
            for rows in held:
                rows.unpersist()

    def _paths(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string").distinct()

    def delete(self, paths: list[str]) -> None:
        now, gone = self.manifest(), self._paths(paths)
        if now is not None and paths:
            chunks, tokens = self._sums(gone, now)
            self._append(now, {}, gone, _TABLES, now.chunks - chunks, now.tokens - tokens)

    def mark(self, paths: list[str], at: int | None) -> int:
        """Writes the marked notes, and nothing else."""
        now, wanted = self.manifest(), self._paths(paths)
        hit = self.read("notes", now).join(wanted, "path", "left_semi").cache()
        try:
            n = hit.count()
            if n:
                self._append(now, {"notes": marked(hit, wanted, at)}, hit.select("path"), ("notes",), now.chunks, now.tokens)
            return n
        finally:
            hit.unpersist()

    # ---- search and numbers

    def text_index(self) -> fts.TextIndex | None:
        """What full-text search over the chunks needs, without reading them."""
        now = self.manifest()
        return None if now is None else fts.TextIndex(self.read("postings", now), "chunk_id", now.chunks, now.tokens / max(1, now.chunks))

    def paths(self) -> DataFrame:
        return self.read("notes").select("path")

    def stats(self) -> dict[str, object]:
        now, fs = self.manifest(), self._files()
        if now is None:
            return {"files": 0, "bytes": 0, "path": self.folder, "modified_ms": None}
        size = sum(fs.getContentSummary(self._path(s["id"])).getLength() for s in now.segments)
        return {"files": self.read("notes", now).count(), "bytes": size, "path": self.folder, "modified_ms": fs.getFileStatus(self._path(f"MANIFEST-{now.number:012d}")).getModificationTime()}
