"""Token ids in wavelet matrices, one a segment of a shard.

Texts are encoded with a ready tokenizer and written, in ascending doc_id order, as segments of
about `segment_tokens` ids. A segment is one wavelet matrix: a bit-plane for every bit of the ids
(most significant first), and for every plane its number of ones in each block of 512 bits. Access, rank (how often an
id stands before a position) and select (where it stands for the n-th time) need one rank or select a plane: the
blocks' counts and the bits of one block. `tokens_at`, `count_tokens` and `locate_token` answer over all files; a plane
is unpacked when it is first asked for.

File format (Parquet, one row a segment; part files are the shards, in doc_id order):
partition int, segment int, first_start long (ids before it in its partition), n_tokens long,
cut boolean (it holds a part of one longer document); ranks binary: <u2 ones of each block, plane by plane; planes
array<binary>: packed bits, each padded to whole blocks; pieces binary: for each document or part
<i8 [doc_id, is_null, n_tokens, is_last]. All binaries are zstd frames.

Texts are dealt by range of doc_id before they are encoded, so ids are never shuffled. Encoding
remembers the ids of each blank-separated word; no rule of the tokenizer reaches over white
space, which tests check against whole-text encoding.

Defined results: a null or empty text is its end id alone; a null doc_id comes first; rows with
the same doc_id are ordered by text. A text longer than a segment spans several; their checksums are combined, not
their ids. An empty table gives an empty file set.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import BYTE_VALUES, PIECE, arrow_rows, cut_pieces, document_texts, running_hashes, shared_folder

BLOCK = 512
FILE_SCHEMA = "partition int, segment int, first_start long, n_tokens long, cut boolean, ranks binary, planes array<binary>, pieces binary"


# ------------------------------------------------------------------ wavelet matrix


class WaveletMatrix:
    """A sequence of ids as bit-planes; plane p holds bit (n_planes - 1 - p) of the ids as the planes
    before have sorted them: those with a 0 first, in order, then those with a 1."""

    def __init__(self, n: int, frames: list[bytes], ranks: bytes):
        self.n, self.frames = n, frames
        ones = np.frombuffer(_unpacked(ranks), "<u2").reshape(len(frames), -1)
        # before[p][i]: ones of plane p before block i
        self.before = np.concatenate([np.zeros((len(frames), 1), np.int64), np.cumsum(ones, axis=1, dtype=np.int64)], axis=1)
        self.zeros = (n - self.before[:, -1]).tolist()
        self._planes: dict[int, np.ndarray] = {}

    @staticmethod
    def pack(ids: np.ndarray, n_planes: int) -> tuple[list[bytes], bytes]:
        """The planes and their ranks, compressed."""
        frames, ranks, now = [], [], ids
        for shift in range(n_planes - 1, -1, -1):
            bits = (now & now.dtype.type(1 << shift)) != 0
            plane = np.packbits(bits)
            plane = np.pad(plane, (0, -len(plane) % (BLOCK // 8)))
            frames.append(_packed(plane))
            ranks.append(np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype="<u2"))
            # gathers by place are twice as fast as by mask
            now = np.concatenate([now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))])
        return frames, _packed(np.concatenate(ranks))

    def plane(self, p: int) -> np.ndarray:
        if p not in self._planes:
            self._planes[p] = np.frombuffer(_unpacked(self.frames[p]), np.uint8)
        return self._planes[p]

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        planes = len(self.frames)
        now = np.zeros(self.n, np.uint32 if planes > 16 else np.uint16)
        for p in range(planes - 1, -1, -1):
            bits, zeros = np.unpackbits(np.frombuffer(_unpacked(self.frames[p]), np.uint8), count=self.n).view(bool), self.zeros[p]
            before = np.empty_like(now)
            before[np.flatnonzero(~bits)] = now[:zeros]
            before[np.flatnonzero(bits)] = now[zeros:] | now.dtype.type(1 << (planes - 1 - p))
            now = before
        return now

    def _block(self, p: int, block: int) -> np.ndarray:
        return np.unpackbits(self.plane(p)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])

    def _ones(self, p: int, at: int) -> int:
        """Ones before position `at`: those of the blocks before and of the rest."""
        block, rest = divmod(at, BLOCK)
        return int(self.before[p, block]) + (int(self._block(p, block)[:rest].sum()) if rest else 0)

    def access(self, at: int) -> int:
        out = 0
        for p, zeros in enumerate(self.zeros):
            ones = self._ones(p, at)
            bit = int(self.plane(p)[at // 8] >> (7 - at % 8)) & 1
            out, at = out << 1 | bit, zeros + ones if bit else at - ones
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p, zeros in enumerate(self.zeros):
            if start == end:
                break
            bit = token >> (len(self.zeros) - 1 - p) & 1
            a, z = self._ones(p, start), self._ones(p, end)
            start, end = (zeros + a, zeros + z) if bit else (start - a, end - z)
        return start, end

    def rank(self, token: int, end: int) -> int:
        """How often `token` stands before `end`."""
        if token >> len(self.zeros):
            return 0
        a, z = self._range(token, 0, end)
        return z - a

    def _find(self, p: int, bit: int, nth: int) -> int:
        """The position of the nth (from 0) `bit` in a plane: a search over blocks, then in one block."""
        ones = self.before[p]
        counts = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(counts, nth, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(p, block) == bit)[nth - int(counts[block])])

    def select(self, token: int, nth: int) -> int:
        """Where `token` stands for the nth time (from 0)."""
        if not 0 <= nth < self.rank(token, self.n):
            raise IndexError(nth)
        at = self._range(token, 0, self.n)[0] + nth
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - p) & 1
            at = self._find(p, bit, at - self.zeros[p] if bit else at)
        return at


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def _crc_times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits in reflected order."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of byte strings one after another, from (crc32, length) of each."""
    out = 0
    for crc, length in parts:
        shift, power = 1 << 31, 1 << 23  # x to the 0th, x to the 8th
        while length:
            if length & 1:
                shift = _crc_times(shift, power)
            power, length = _crc_times(power, power), length >> 1
        out = _crc_times(out, shift) ^ crc
    return out


# ------------------------------------------------------------------ encoding


def drops_white_space(spec: str) -> bool:
    """Whether a tokenizer's own rules (its JSON) turn runs of white space into one blank and then keep
    only pieces without any: words between white space can be encoded alone."""
    rules = json.loads(spec)
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    blanks = [x for x in (rules.get("normalizer") or {}).get("normalizers", []) if x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"}]
    pieces = re.sub(r"\[\^[^\]]*\]|\[[^\]]*\]\+?", "", pattern)
    return bool(blanks) and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in pattern and not re.search(r"\\s| |\.", pieces)


def plain_byte_level(spec: str) -> bool:
    """Whether letters are composed, lower-cased and handed to the model as bytes, one piece a run of
    letters or of marks."""
    rules = json.loads(spec)
    normalizers = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    pieces = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return normalizers == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pieces] == ["Split", "ByteLevel"] and not pieces[1]["add_prefix_space"] and not pieces[1]["use_regex"] and "[\\p{L}]+|" in pieces[0]["pattern"]["Regex"] and pieces[0]["pattern"]["Regex"].endswith("|[^\\s\\p{L}\\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Texts of white space, Latin letters that lower-case one by one, digits and signs, without an apostrophe (which
#: starts pieces like 's) and without "<" (which may start a special token). Their pieces are runs of letters,
#: single digits and runs of signs.
_SIMPLE = re.compile("[\t-\r -&(-;=-~À-ÖØ-öø-ÿ]*")
LETTER, DIGIT, SIGN = 1, 2, 3
#: What each Latin-1 code of a simple text, lower-cased, is; 0 is white space.
_KINDS = np.array([0 if c == 32 or 9 <= c <= 13 else DIGIT if 48 <= c <= 57 else LETTER if 97 <= c <= 122 or c >= 0xDF else SIGN for c in range(256)], np.uint8)


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for lengths[i] places, of all i one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceTable:
    """Ids of up to `most` pieces in arrays, found by hash and compared by their letters. When it is full, the half
    that was used last stays."""

    def __init__(self, dtype, most: int = 1 << 18):
        self.most, self.mask, self.dtype, self.clock = most, 4 * most - 1, dtype, 0
        self._start()

    def _start(self) -> None:
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.n = 0
        self.keys, self.used = np.zeros(self.most, np.uint64), np.zeros(self.most, np.int64)
        self.spelled, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)
        self.at = np.zeros((2, self.most), np.int64)  # where a piece's letters and ids start
        self.size = np.zeros((2, self.most), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't known."""
        out, at, todo = np.full(len(keys), -1, np.int32), (keys >> np.uint64(40)).astype(np.int64) & self.mask, np.arange(len(keys))
        while len(todo):
            got = self.slots[at[todo]]
            same = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[same]] = got[same]
            todo = todo[(got >= 0) & ~same]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, spelled: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Pieces with different keys that aren't known: letters and ids of all, and how many each has."""
        if self.n + len(keys) > self.most:
            kept = np.sort(np.argsort(-self.used[: self.n], kind="stable")[: max(0, self.most // 2 - len(keys))])
            old = (self.keys[kept], self.used[kept], [self.spelled[_ragged(self.at[0, kept], self.size[0, kept])], self.ids[_ragged(self.at[1, kept], self.size[1, kept])]], self.size[:, kept])
            if len(keys) > self.most:
                self.most, self.mask = 2 * len(keys), (4 << (2 * len(keys)).bit_length()) - 1
            self._start()
            self._put(*old)
        self._put(keys, np.full(len(keys), self.clock, np.int64), [spelled, ids], np.array([sizes, counts], np.int64))

    def _put(self, keys: np.ndarray, used: np.ndarray, pools: list[np.ndarray], sizes: np.ndarray) -> None:
        to = slice(self.n, self.n + len(keys))
        self.keys[to], self.used[to], self.size[:, to] = keys, used, sizes
        self.at[:, to] = np.cumsum(sizes, axis=1) - sizes + np.array([[len(self.spelled)], [len(self.ids)]])
        self.spelled, self.ids = np.concatenate([self.spelled, pools[0]]), np.concatenate([self.ids, pools[1]])
        number, at, todo = np.arange(to.start, to.stop, dtype=np.int32), (keys >> np.uint64(40)).astype(np.int64) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = number[free]  # of several for one slot one stays
            todo = todo[self.slots[at[todo]] != number[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.n = to.stop

    def encode(self, data: bytes, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Start, number of ids and ids of the pieces of a simple text; None where two pieces have one hash."""
        codes = np.frombuffer(data, np.uint8)
        kinds = np.zeros(len(codes) + 2, np.uint8)
        kinds[1:-1] = _KINDS[codes]
        inner = kinds[1:-1]
        alone = inner == DIGIT
        starts = np.flatnonzero((inner > 0) & (alone | (inner != kinds[:-2])))
        ends = np.flatnonzero((inner > 0) & (alone | (inner != kinds[2:]))) + 1
        keys = running_hashes(BYTE_VALUES[codes], starts, ends)
        self.clock += 1
        number = self.find(keys)
        if (number < 0).any():
            unknown = np.flatnonzero(number < 0)
            fresh, where = np.unique(keys[unknown], return_index=True)
            where = unknown[where]
            sizes = ends[where] - starts[where]
            spelled = codes[_ragged(starts[where], sizes)]
            self.used[number[number >= 0]] = self.clock
            self.add(fresh, spelled, sizes, *learn(spelled, sizes))
            number = self.find(keys)
            if (number < 0).any():  # the table was halved meanwhile: what this text needs comes back
                return self.encode(data, learn)
        self.used[number] = self.clock
        sizes = self.size[0, number]
        if not (np.array_equal(sizes, ends - starts) and np.array_equal(self.spelled[_ragged(self.at[0, number], sizes)], codes[inner > 0])):
            return None
        counts = self.size[1, number]
        return starts, counts, self.ids[_ragged(self.at[1, number], counts)]


class WordEncoder:
    """Ids of texts by a `tokenizers` file. A simple text is cut into the pieces that the tokenizer's rules would
    cut it into, and new pieces go straight to the tokenizer's model; a word of any other text goes through all
    its rules. Remembers the ids of `most` pieces and as many words."""

    def __init__(self, path: str, most: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        spec = self.tokenizer.to_str()
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocabulary.values()) < 2**16 else np.uint32
        self.by_word = drops_white_space(spec)
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.plain = self.by_word and plain_byte_level(spec) and bool(suffix)
        self.words: dict[bytes, bytes] = {}
        if self.plain:
            self.table, self.letters = PieceTable(self.dtype, most), _byte_letters() | {32: " "}
            # the same model on ready pieces with a blank between; a piece ends with a token that has the suffix
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _learn(self, spelled: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has, from their Latin-1 letters."""
        row = np.full(len(spelled) + len(sizes), 32, np.uint8)
        row[_ragged(np.cumsum(sizes + 1) - sizes - 1, sizes)] = spelled
        text = row.tobytes().decode("latin-1")
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _by_word(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").split()
        if len(self.words) > self.most:
            self.words = {}
        new = list({w for w in words if w not in self.words})
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            for word, e in zip(part, self.tokenizer.encode_batch([w.decode("utf-8") for w in part], add_special_tokens=False), strict=True):
                self.words[word] = np.array(e.ids, self.dtype).tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def _simple(self, texts: list[str]) -> list[bytes] | None:
        """All texts together, or one long text piece by piece."""
        parts = [t.lower().encode("latin-1") for t in texts]
        if len(parts) == 1 and len(parts[0]) > PIECE:
            found = [self.table.encode(part, self._learn) for part in cut_pieces(parts[0])]
            return None if None in found else [b"".join(f[2].tobytes() for f in found)]
        found = self.table.encode(b"\n".join(parts), self._learn)
        if found is None:
            return None
        starts, counts, ids = found
        ends = np.cumsum([len(p) + 1 for p in parts])
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, ends)] * ids.itemsize
        packed = ids.tobytes()
        return [packed[a:z] for a, z in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, packed."""
        if not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        simple = [i for i, t in enumerate(texts) if self.plain and _SIMPLE.fullmatch(t)]
        out: dict[int, bytes] = {}
        while simple:
            part, size = [], 0
            while simple and (not part or size + len(texts[simple[-1]]) <= PIECE):
                part.append(simple.pop())
                size += len(texts[part[-1]])
            out.update(zip(part, self._simple([texts[i] for i in part]) or (), strict=False))
        return [out[i] if i in out else self._by_word(t) for i, t in enumerate(texts)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which Spark uses again."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _segments(path: str, end_id: int, n_planes: int, segment_tokens: int, batch_chars: int = 400_000):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(path)
        width = np.dtype(code.dtype).itemsize
        most = segment_tokens * width
        partition, segment, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        pieces: list[tuple[int, int, int, int]] = []
        held = 0

        def flush(cut: bool = False) -> pa.RecordBatch:
            nonlocal ids, pieces, held, segment, start
            planes, ranks = WaveletMatrix.pack(np.frombuffer(b"".join(ids), code.dtype), n_planes)
            columns = {"partition": pa.array([partition], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_start": pa.array([start], pa.int64()), "n_tokens": pa.array([held // width], pa.int64()), "cut": pa.array([cut])}
            columns |= {"ranks": pa.array([ranks], pa.binary()), "planes": pa.array([planes], pa.list_(pa.binary())), "pieces": pa.array([_packed(np.array(pieces, "<i8"))], pa.binary())}
            out = pa.RecordBatch.from_pydict(columns)
            ids, pieces, start, held, segment = [], [], start + held // width, 0, segment + 1
            return out

        def placed(doc_ids: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            end = np.array([end_id], code.dtype).tobytes()
            for doc_id, own in zip(doc_ids, code.encode(texts), strict=True):
                own += end
                if held and held + len(own) > most:
                    yield flush()
                long = len(own) > most
                for at in range(0, len(own), most):
                    part = own[at : at + most] if long else own
                    ids.append(part)
                    held += len(part)
                    pieces.append((doc_id or 0, int(doc_id is None), len(part) // width, int(at + most >= len(own))))
                    if long:
                        yield flush(cut=True)

        for batch in batches:
            doc_ids: list[int | None] = []
            texts: list[str] = []
            chars = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                doc_ids.append(doc_id)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars:
                    yield from placed(doc_ids, texts)
                    doc_ids, texts, chars = [], [], 0
            yield from placed(doc_ids, texts)
        if held:
            yield flush()

    return rows


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, vocabulary: int = 49_408, segment_tokens: int = 1_000_000, partitions: int | None = None) -> None:
    """Writes the ids of all `docs`, each followed by `end_id`, below `folder`; as many shards as Spark has shuffle
    partitions, or as the input has partitions (which follow its bytes), whatever is more."""
    if end_id >= vocabulary:
        raise ValueError("end_id is outside the vocabulary")
    texts = document_texts(docs)
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    ordered = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    n_planes = max(1, (vocabulary - 1).bit_length())
    ordered.mapInArrow(arrow_rows(_segments(tokenizer_path, end_id, n_planes, segment_tokens)), FILE_SCHEMA).write.option("compression", "none").parquet(folder)


def _stored_segments(batch: pa.RecordBatch) -> Iterator[tuple[dict, WaveletMatrix]]:
    for row in batch.to_pylist():
        yield row, WaveletMatrix(row["n_tokens"], row["planes"], row["ranks"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, or part of one that is cut."""
    names = ["partition", "doc_id", "at", "n_tokens", "ids_crc32", "cut", "is_last"]
    for batch in batches:
        for row, matrix in _stored_segments(batch):
            pieces = np.frombuffer(_unpacked(row["pieces"]), "<i8").reshape(-1, 4)
            data = matrix.decode().astype("<u4").tobytes()
            ends = np.cumsum(pieces[:, 2])
            begins = ends - pieces[:, 2]
            crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(pieces)
            ids = pa.array(pieces[:, 0], pa.int64(), mask=pieces[:, 1] != 0)
            yield pa.RecordBatch.from_arrays([pa.array([row["partition"]] * n, pa.int32()), ids, pa.array(row["first_start"] + begins, pa.int64()), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array([row["cut"]] * n), pa.array(pieces[:, 3] != 0)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [joined_crc([(p["ids_crc32"], 4 * p["n_tokens"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        columns = [batch.column(c) for c in ("partition", "doc_id", "at", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], ["partition", "doc_id", "at", "n_tokens", "ids_crc32"])


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The segments, and the ids before each partition: one row a partition of the files, whose number is that of
    the shards."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = files.groupBy("partition").agg(F.sum("n_tokens").alias("total"))
    return files, totals.select("partition", (F.sum("total").over(Window.orderBy("partition")) - F.col("total")).alias("offset"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32."""
    files, offsets = _files(spark, folder)
    found = "partition int, doc_id long, at long, n_tokens long, ids_crc32 long"
    whole = files.filter("not cut").mapInArrow(arrow_rows(_documents), found + ", cut boolean, is_last boolean").drop("cut", "is_last")
    # a document longer than a segment: its parts, numbered by the ends of those before
    parts = files.filter("cut").mapInArrow(arrow_rows(_documents), found + ", cut boolean, is_last boolean")
    w = Window.partitionBy("partition").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("k", F.coalesce(F.sum(F.col("is_last").cast("int")).over(w), F.lit(0)))
    grouped = parts.groupBy("partition", "k").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n_tokens").alias("total"), F.array_sort(F.collect_list(F.struct("at", "n_tokens", "ids_crc32"))).alias("parts"))
    joined = grouped.select("partition", "doc_id", "at", F.col("total").alias("n_tokens"), "parts").mapInArrow(arrow_rows(_joined), found)
    return whole.unionByName(joined).join(F.broadcast(offsets), "partition").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    files, offsets = _files(spark, folder)
    return files.join(F.broadcast(offsets), "partition").withColumn("start", F.col("first_start") + F.col("offset"))


def tokens_at(spark: SparkSession, folder: str, positions: list[int]) -> DataFrame:
    """position, token of each of the given positions that the files have; only segments that hold one are read."""
    wanted = np.unique(np.array(positions, np.int64))
    asked = spark.createDataFrame([(int(p),) for p in wanted], "position long")
    segments = _placed(spark, folder).join(F.broadcast(asked), (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens")), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, matrix in _stored_segments(batch):
                own = wanted[(wanted >= row["start"]) & (wanted < row["start"] + row["n_tokens"])]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([matrix.access(p) for p in (own - row["start"]).tolist()], pa.int64())], ["position", "token"])

    return segments.select("start", "n_tokens", "ranks", "planes").mapInArrow(arrow_rows(rows), "position long, token long")


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the given tokens stands in all files, by ranks alone."""
    wanted = sorted(set(tokens))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in _stored_segments(batch):
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.rank(t, matrix.n) for t in wanted], pa.int64())], ["token", "n"])

    files, _ = _files(spark, folder)
    return files.select("n_tokens", "ranks", "planes").mapInArrow(arrow_rows(rows), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def locate_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """position: every place where `token` stands, by select."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, matrix in _stored_segments(batch):
                found = [row["start"] + matrix.select(token, i) for i in range(matrix.rank(token, matrix.n))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["position"])

    return _placed(spark, folder).select("start", "n_tokens", "ranks", "planes").mapInArrow(arrow_rows(rows), "position long")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, **options) -> DataFrame:
    """Writes the files (into `folder`, or a new one in the shared folder) and reads them back."""
    folder = folder or shared_folder(docs.sparkSession)
    write_tokens(docs, folder, tokenizer_path, end_id, **options)
    return read_documents(docs.sparkSession, folder)
