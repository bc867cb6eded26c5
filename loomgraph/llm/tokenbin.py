"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum per frame.

Layout of a file: the frames one after another, each the little-endian unsigned 32-bit ids of some whole
documents; then, as a zstandard skippable frame, the table: 8-byte magic number and length, the entries
(doc_id, n_tokens per document; compressed size, raw size, documents, crc32 of the raw bytes per frame),
and a footer (entry counts, ids before this file's first, crc32 of the table, magic), so that a reader
starts from the end and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import _store
from loomgraph.llm._ranges import partitioned, with_range
from loomgraph.llm._text import U64, mix, pieces, span_hashes, text_bytes

END_ID = 2
#: Ids in a frame, about; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
SHARD_BYTES = 24 << 20
SKIPPABLE = 0x184D2A5E
MAGIC = b"LGTOKID1"
FOOTER = struct.Struct("<QQI8s")
FRAME = np.dtype([("packed", "<u8"), ("raw", "<u8"), ("docs", "<u8"), ("crc", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("n_tokens", "<u8")])


class Encoder:
    """Ids of texts by the tokenizers library, encoding each distinct stretch between spaces once.

    A byte-level pre-tokenizer always starts a new piece at a space between two characters that are no
    white space, at a line end between two such, and at a stop between a Latin letter or digit and white
    space, so the ids of a text are those of its stretches in a row.  All texts of a batch are cut there at
    once, on their bytes, and stretches are found by their hash in a table of those met before; new ones are
    encoded some at a time.  Texts where such a cut was wrong are cut with care and encoded apart.  The
    table is bounded: when it is full, the half that came first, which holds the common ones, stays.
    """

    RAW = "\0"  # marks a stretch without a space before it
    #: Stretches encoded in one text.
    BUNDLE = 32
    _NO_SPACE = U64(0x9E3779B97F4A7C15)
    _before_stop = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | frozenset(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))

    def __init__(self, path: str, room: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room = room
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how a byte-level vocabulary writes a space
        self.mask = U64((1 << max(8, 2 + int(room).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0
        # of each known stretch: hash, size in bytes, whether a cut beside it is wrong, whether a stop may follow, whether it is one
        self.key, self.size = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.int32)
        self.wrong, self.latin, self.stop = (np.zeros(1 << 12, dtype=bool) for _ in range(3))
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.zeros((1 << 12) + 1, np.int64)

    # ---- the table ----

    def _find(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each stretch, -1 if it is not known."""
        out = np.full(len(key), -1, np.int32)
        todo, place = None, (key & self.mask).astype(np.int64)
        own, own_size = key, size
        while len(place):
            number = self.slot[place]
            at = np.maximum(number, 0)
            met = number >= 0
            same = met & (self.key[at] == own) & (self.size[at] == own_size)
            if todo is None:
                out[same] = number[same]
                todo = np.flatnonzero(met & ~same)
            else:
                out[todo[same]] = number[same]
                todo = todo[met & ~same]
            own, own_size = key[todo], size[todo]
            place = (place[met & ~same] + 1) & int(self.mask)
        return out

    def _put(self, first: int) -> None:
        """Enter the stretches from this number on."""
        todo = np.arange(first, self.n, dtype=np.int32)
        place = (self.key[todo] & self.mask).astype(np.int64)
        while len(todo):
            free = self.slot[place] < 0
            self.slot[place[free]] = todo[free]
            left = self.slot[place] != todo
            todo, place = todo[left], (place[left] + 1) & int(self.mask)

    def _grown(self, name: str, n: int) -> None:
        held = getattr(self, name)
        while len(held) < n:
            held = np.concatenate([held, np.zeros_like(held)])
        setattr(self, name, held)

    def _forget(self) -> None:
        self.n = self.room // 2
        self.slot[:] = -1
        self._put(0)

    # ---- learning ----

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_wrong(self, stretch: str) -> bool:
        """Whether a cut beside this stretch has white space on both sides."""
        if stretch == "\0\n":
            return False
        if stretch[-1].isspace():
            return True
        return stretch[0] == self.RAW and stretch[1].isspace()

    def _learn(self, stretches: list[str], key: np.ndarray, size: np.ndarray) -> None:
        """Encode stretches and enter them; those beside which cuts are wrong get no ids."""
        rough = re.compile(r"\0|\s|<\|")
        wrong = [self._is_wrong(s) for s in stretches]
        simple = [i for i, s in enumerate(stretches) if not wrong[i] and not rough.search(s)]
        other = [i for i, s in enumerate(stretches) if not wrong[i] and rough.search(s)]
        step = self.BUNDLE
        texts = [stretches[i] for i in simple]
        ids = np.fromiter(itertools.chain.from_iterable(self._ids([" " + " ".join(texts[i : i + step]) for i in range(0, len(texts), step)])), np.uint32)
        lengths = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        single = self._ids([stretches[i][1:] if stretches[i].startswith(self.RAW) else " " + stretches[i] for i in other])
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(single), np.uint32)])
        lengths = np.concatenate([lengths, np.fromiter(map(len, single), np.int64, len(single))])
        if len(lengths) != len(simple) + len(other):
            raise ValueError("the tokenizer joined stretches")
        order = np.array(simple + other + [i for i, w in enumerate(wrong) if w], np.int64)
        lengths = np.concatenate([lengths, np.zeros(len(order) - len(lengths), np.int64)])
        base, n = self.n, self.n + len(order)
        used = int(self.at[base])
        self._grown("ids", used + len(ids))
        self._grown("at", n + 1)
        for name in ("key", "size", "wrong", "latin", "stop"):
            self._grown(name, n)
        self.ids[used : used + len(ids)] = ids
        self.at[base + 1 : n + 1] = used + np.cumsum(lengths)
        self.key[base:n], self.size[base:n] = key[order], size[order]
        self.wrong[base:n] = np.array(wrong)[order]
        self.latin[base:n] = [stretches[i][-1] in self._before_stop for i in order.tolist()]
        self.stop[base:n] = [stretches[i] in ("\0.", "\0,") for i in order.tolist()]
        self.n = n
        self._put(base)

    # ---- texts ----

    def stretches(self, text: str) -> list[str]:
        """The text cut before each single space between two characters that are no white space; that space is left out."""
        if self.RAW in text:
            return [self.RAW + text]
        parts = text.split(" ")
        out = [self.RAW + parts[0]]
        joined = not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if joined or not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
            joined = not p or p[-1].isspace()
        return out

    def _slow(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per text) of texts whose quick cuts are wrong, each careful stretch encoded anew."""
        cut = [self.stretches(t) for t in texts]
        coded = self._ids([s[1:] if s.startswith(self.RAW) else " " + s for c in cut for s in c])
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        per = np.add.reduceat(lengths, np.concatenate([[0], ends[:-1]]))
        return np.fromiter(itertools.chain.from_iterable(coded), np.uint32), per

    @staticmethod
    def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start and end of each stretch, whether a space stands before it, whether each text is badly cut).

        Cuts are at spaces, which are left out, around line ends, and before a stop with white space after it.
        A text is badly cut if a stretch would be empty, or if it is or holds a null character.
        """
        n, texts = len(raw), len(offsets) - 1
        first, last = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        last[offsets[1:] - 1] = True  # of an empty text: a place that its neighbours mark as well, or none
        first, last = first[:n], last[:n]
        space, line = raw == 32, raw == 10
        white = space | line
        after = np.append(white[1:], False) & ~last
        before = np.append(False, white[:-1]) & ~first
        space_before = np.append(False, space[:-1]) & ~first
        stop = ((raw == 44) | (raw == 46)) & after
        begins = ~space & (first | before | line | stop)
        ends = ~space & (last | after | line | np.append(stop[1:], False) & ~last)
        spoilt = (raw == 0) | (white & (first | last | before)) | (stop & (first | before))
        bad = np.zeros(texts, dtype=bool)
        bad[np.searchsorted(offsets, np.flatnonzero(spoilt), side="right") - 1] = True
        bad[np.diff(offsets) == 0] = True
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, space_before[start], bad

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text), each text with the end id after it; a null text is empty."""
        if self.n > self.room:
            self._forget()
        raw, offsets = text_bytes(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string()))
        if len(offsets) == 1:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        start, end, spaced, worse = self._cut(raw, offsets)
        key, size = span_hashes(raw, start, end), (end - start).astype(np.int32)
        key[~spaced] = mix(key[~spaced] + self._NO_SPACE)
        bound = np.searchsorted(start, offsets)
        good = np.repeat(~worse, np.diff(bound))
        which = self._find(key, size)
        missing = np.flatnonzero((which < 0) & good)
        if len(missing):
            _, one = np.unique(key[missing], return_index=True)
            one = missing[one]
            view = memoryview(np.ascontiguousarray(raw))
            fresh = [("" if s else self.RAW) + str(view[a:b], "utf-8") for a, b, s in zip(start[one].tolist(), end[one].tolist(), spaced[one].tolist(), strict=True)]
            self._learn(fresh, key[one], size[one])
            which[missing] = self._find(key[missing], size[missing])
        which = np.maximum(which, 0)
        spoilt = self.wrong[which] & good
        spoilt[1:] |= self.stop[which[1:]] & ~self.latin[which[:-1]] & good[1:]
        owner = np.repeat(np.arange(len(worse)), np.diff(bound))
        worse[owner[spoilt]] = True
        good = ~worse[owner]
        begin = self.at[which]
        lengths = np.where(good, self.at[which + 1] - begin, 0)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(sums[bound]) + 1
        ends = np.cumsum(lengths) + owner  # a slot for the end id after each text
        source = np.repeat(begin - ends + lengths, lengths)
        place = np.arange(len(source)) + np.repeat(owner, lengths)
        out = np.empty(int(sizes.sum()), np.uint32)
        out[place] = self.ids[source + place]
        out[np.cumsum(sizes) - 1] = END_ID
        if not worse.any():
            return out, sizes
        some = np.flatnonzero(worse).tolist()
        view = memoryview(np.ascontiguousarray(raw))
        again, per = self._slow([str(view[a:b], "utf-8") for a, b in zip(offsets[:-1][worse].tolist(), offsets[1:][worse].tolist(), strict=True)])
        last, parts, upto = 0, [], np.cumsum(sizes)
        for i, ids in zip(some, np.split(again, np.cumsum(per)[:-1]), strict=True):
            parts += [out[last : upto[i] - 1], ids, out[upto[i] - 1 : upto[i]]]
            last = upto[i]
        sizes[worse] = per + 1
        return np.concatenate([*parts, out[last:]]), sizes


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


class Writer:
    """One file; documents are given in order.  It appears under its name only when it is whole."""

    def __init__(self, url: str, level: int = 1) -> None:
        self.fs, self.path = _open(url)
        self.temp = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}.part"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.waiting_docs = self.waiting_ids = self.total = 0

    def add(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        entry = np.zeros(len(doc_ids), DOC)
        entry["doc_id"], entry["known"], entry["n_tokens"] = doc_ids, known, counts
        self.docs.append(entry)
        bound = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(counts):
            upto = int(np.searchsorted(bound, bound[at] + FRAME_IDS - self.waiting_ids, side="right")) - 1
            upto = min(len(counts), max(upto, at if self.waiting_docs else at + 1))
            if upto > at:
                self.waiting.append(ids[bound[at] : bound[upto]])
                self.waiting_docs += upto - at
                self.waiting_ids += int(bound[upto] - bound[at])
                at = upto
            if at < len(counts):
                self._flush()

    def _flush(self) -> None:
        if not self.waiting_docs:
            return
        raw = np.concatenate(self.waiting).astype("<u4").tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), self.waiting_docs, zlib.crc32(raw)))
        self.total += self.waiting_ids
        self.waiting, self.waiting_docs, self.waiting_ids = [], 0, 0

    def close(self) -> int:
        """Ids in the file."""
        self._flush()
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, DOC)
        table = np.array(self.frames, FRAME).tobytes() + docs.tobytes()
        body = table + FOOTER.pack(len(self.frames), len(docs), zlib.crc32(table), MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.total


    def summary(self, shard: int) -> pa.RecordBatch:
        """Close the file: its number, ids, and least and greatest doc_id (null: no id in it is known)."""
        ids = [d["doc_id"][d["known"] == 1] for d in self.docs]
        ids = np.concatenate([*ids, np.empty(0, np.int64)])
        ends = [int(ids.min()), int(ids.max())] if len(ids) else [None, None]
        row = {"shard": pa.array([shard], pa.int32()), "n_ids": pa.array([self.close()], pa.int64())}
        return pa.RecordBatch.from_pydict(row | {k: pa.array([v], pa.int64()) for k, v in zip(("first_id", "last_id"), ends, strict=True)})


SHARDS = "shard int, n_ids long, first_id long, last_id long"


class Reader:
    """Reads the table from the end of a file, then only the frames that are asked for."""

    def __init__(self, url: str) -> None:
        fs, path = _open(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n_frames, n_docs, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-ID file")
        length = n_frames * FRAME.itemsize + n_docs * DOC.itemsize
        table = self.file.read_at(length, size - FOOTER.size - length)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(table, FRAME, n_frames)
        self.docs = np.frombuffer(table, DOC, n_docs, n_frames * FRAME.itemsize)
        self.offset = np.concatenate([[0], np.cumsum(self.frames["packed"])]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"])]).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor()
        self.decompressed = 0

    def frame(self, k: int) -> np.ndarray:
        entry = self.frames[k]
        raw = self.unpack.decompress(self.file.read_at(int(entry["packed"]), int(self.offset[k])), max_output_size=int(entry["raw"]))
        self.decompressed += 1
        if zlib.crc32(raw) != entry["crc"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int | None) -> list[int]:
        """The places of the documents of this id in the file, from the table alone; documents stand in order of id, null first."""
        known = int(np.searchsorted(self.docs["known"], 1))
        if doc_id is None:
            return list(range(known))
        ids = self.docs["doc_id"][known:]
        return list(range(known + int(np.searchsorted(ids, doc_id)), known + int(np.searchsorted(ids, doc_id, side="right"))))

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at a place in the file."""
        k = int(np.searchsorted(self.first, position, side="right")) - 1
        counts = self.docs["n_tokens"][self.first[k] : self.first[k + 1]].astype(np.int64)
        bound = np.concatenate([[0], np.cumsum(counts)])
        here = position - self.first[k]
        return self.frame(k)[bound[here] : bound[here + 1]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _write(url: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        writer, shard = None, None
        for batch in pieces(batches, "text", 2 << 20):
            shards = batch.column("shard").to_numpy()
            for lo in [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist()]:
                if shards[lo] != shard:
                    if writer:
                        yield writer.summary(shard)
                    shard = int(shards[lo])
                    writer = Writer(f"{url}/part-{shard:06d}.tid")
                part = batch.slice(lo, int(np.searchsorted(shards, shard, side="right")) - lo)
                ids, counts = encoder.encode(part.column("text"))
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                writer.add(part.column("doc_id").fill_null(0).to_numpy(), known, counts, ids)
        if writer:
            yield writer.summary(shard)

    return run


def write(documents: DataFrame, url: str, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the documents' ids as files in `url`, in order of doc_id; returns (shard, n_ids, first_id, last_id) of each file.

    Files hold ranges of doc_id; bounds are approximate quantiles over all ids, so a file holds about
    `shard_bytes` of text.  A null id comes first, a null text is empty, rows of one doc_id follow each
    other in order of their texts.  The folder must be one that all executors reach; what failed attempts
    left in it is dropped at the end.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt, n = with_range(docs, shard_bytes)
    rows = partitioned(dealt.withColumnRenamed("part", "shard"), "shard", n).sortWithinPartitions("shard", "doc_id", "text")
    got = rows.mapInArrow(_write(url, tokenizer or default_tokenizer()), SHARDS).toArrow()
    _store.drop_parts(spark, url)
    return spark.createDataFrame([tuple(r.values()) for r in got.to_pylist()], SHARDS)


def _read(url: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(f"{url}/part-{shard:06d}.tid")
                for k in range(len(reader.frames)):
                    docs = reader.docs[reader.first[k] : reader.first[k + 1]]
                    counts = docs["n_tokens"].astype(np.int64)
                    bound = np.concatenate([[0], np.cumsum(counts)])
                    raw = memoryview(reader.frame(k)).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs["doc_id"], mask=docs["known"] == 0),
                            "start": pa.array(start + bound[:-1]),
                            "n_tokens": pa.array(counts),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    start += int(bound[-1])

    return run


def read(spark: SparkSession, url: str, shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32.  `shards`: what write() gave."""
    rows = sorted((r["shard"], r["n_ids"]) for r in shards.collect())
    start, at = [], 0
    for shard, n in rows:
        start.append((shard, at))
        at += n
    todo = spark.createDataFrame(start, "shard int, start long").repartition(max(1, len(start)), "shard")
    return todo.mapInArrow(_read(url), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(url: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            for shard, doc_id in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if shard != opened:
                    reader, opened = Reader(f"{url}/part-{shard:06d}.tid"), shard
                for place in reader.find(doc_id):
                    ids = pa.array([reader.document(place).astype(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), ids], names=["doc_id", "ids"])

    return run


def fetch(wanted: DataFrame, url: str, shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of each row of the documents named in `wanted`; only frames that hold one of them are decompressed.

    `shards` is what write() gave: an id's file is the one whose range holds it, and the file's own table
    tells the frame.  Ids that are in no file give no row; an id asked for twice is given twice.
    """
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id"))
    held = shards.filter("first_id is not null").select("shard", "first_id", "last_id")
    met = ids.join(F.broadcast(held), (ids["doc_id"] >= held["first_id"]) & (ids["doc_id"] <= held["last_id"])).select("shard", "doc_id")
    return met.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(_fetch(url), "doc_id long, ids array<long>")


def round_trip(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' files to the shared folder and read them back; no documents, no rows."""
    spark = documents.sparkSession
    url = _store.new_folder(spark, "token-ids")
    return read(spark, url, write(documents, url, tokenizer))
