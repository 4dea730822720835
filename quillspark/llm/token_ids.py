"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A shard holds the documents of one range of (doc_id, start of the text), in ascending order, as two
files:

* `.ids`: the ids of all its documents, one after another, as little-endian unsigned words of 2 or 4
  bytes (2 if the vocabulary fits), without separators;
* `.idx`: a header; for each record its doc_id, the place of its first id and whether the doc_id is
  null; for each slot a fingerprint of its key and the key's first record; and the index: levels of
  bits, in blocks with their rank, in which each distinct doc_id has one bit of its own, whose rank
  is its slot.

A lookup hashes the key once a level (1.6 levels on average, whatever the size), reads one block of
72 bytes for each, the slot's 8 bytes and the record's 24, compares the fingerprint, so that unknown
keys are refused, and reads the payload at the stored place: its cost does not grow with the shard.
`lookup` does so for a table of keys over all shards; the shards' limits are two numbers each, and
there are MOST_SHARDS at most. The query's rows come through the index too: a shard's keys are
looked up, and each document is read at the place that its slot gives.

Shards are written under names of their own by each attempt and named in a manifest that Spark
commits with the tasks' results: what a lost or repeated attempt leaves behind is never read.

Results for odd rows: a null or empty text is its end id alone; null ids come first, have no key and
are read in their order; rows with equal ids keep all their records, in the order of their texts, over
several shards if need be, and a lookup gives all of them; an empty table gives no shards; columns
other than doc_id and text are not read, whatever their names. Files are written through pyarrow's
file systems to the folder given or the shared folder.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept
from .hashing import mix

END_ID, MAGIC, MOST_SHARDS = 1, b"QTOKIDS2", 1 << 20
#: Bytes of encoded chunks that a worker keeps, by an estimate.
MOST_KEPT = 192 << 20
MANIFEST = "shard long, path string, n_docs long, n_ids long, first_id long, last_id long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, place long"
HEAD = struct.Struct("<8sqqqqq")
RECORD = np.dtype([("id", "<i8"), ("start", "<i8"), ("null", "<i8")])
SLOT = np.dtype([("print", "<u4"), ("record", "<u4")])
BITS = 512
BLOCK = np.dtype([("rank", "<i8"), ("bits", "u1", BITS // 8)])


# The index

def build_index(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks of bits of each level, and the slot of each of the distinct keys. A key has its bit on
    the first level where no other key left hashes to the same one."""
    levels, slots, base = [], np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    while len(left):
        blocks = np.zeros(-(-len(left) * 2 // BITS), BLOCK)
        at = place(keys[left], len(levels), len(blocks) * BITS)
        bits = np.bincount(at, minlength=len(blocks) * BITS) == 1
        own = bits[at]
        rank = base + np.cumsum(bits) - 1
        slots[left[own]] = rank[at[own]]
        blocks["rank"] = rank[::BITS] - bits[::BITS] + 1
        blocks["bits"] = np.packbits(bits.reshape(-1, BITS), axis=1)
        base += int(bits.sum())
        levels.append(blocks)
        left = left[~own]
    return levels, slots


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


def write_index(ids: np.ndarray, null: np.ndarray, starts: np.ndarray, n_ids: int, width: int) -> bytes:
    """ids ascend, nulls first."""
    real = np.flatnonzero(~null)
    keys, first = np.unique(ids[real], return_index=True)
    levels, slots = build_index(keys)
    table, records = np.zeros(len(keys), SLOT), np.zeros(len(ids), RECORD)
    table["print"][slots], table["record"][slots] = fingerprints(keys), real[first]
    records["id"], records["start"], records["null"] = ids, starts, null
    head = HEAD.pack(MAGIC, width, len(ids), n_ids, len(keys), len(levels))
    return b"".join([head, np.array([len(x) for x in levels], "<i8").tobytes(), records.tobytes(), table.tobytes(), *[x.tobytes() for x in levels]])


class Shard:
    """A shard's two files, opened for reading. Of the index the header alone is read ahead."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        self.index, self.payloads = fs.open_input_file(name + ".idx"), fs.open_input_file(name + ".ids")
        magic, self.width, self.n, self.n_ids, self.n_keys, n_levels = HEAD.unpack(self.index.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.sizes = np.frombuffer(self.index.read(8 * n_levels), "<i8")
        self.records_at = HEAD.size + 8 * n_levels
        self.slots_at = self.records_at + self.n * RECORD.itemsize
        self.levels_at = self.slots_at + self.n_keys * SLOT.itemsize + np.cumsum([0, *self.sizes]) * BLOCK.itemsize

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.index.close()
        self.payloads.close()

    def rows(self, start: int, kind: np.dtype, at: np.ndarray) -> np.ndarray:
        """Entries of one of the index's arrays: one read where they lie close, else one for each."""
        if not len(at):
            return np.empty(0, kind)
        low, high = int(at.min()), int(at.max()) + 1
        if high - low > 16 * len(at) + 256:
            distinct, inverse = np.unique(at, return_inverse=True)
            parts = [self.index.read_at(kind.itemsize, start + int(k) * kind.itemsize) for k in distinct]
            return np.frombuffer(b"".join(parts), kind)[inverse]
        return np.frombuffer(self.index.read_at((high - low) * kind.itemsize, start + low * kind.itemsize), kind)[at - low]

    def records(self, at: np.ndarray) -> np.ndarray:
        return self.rows(self.records_at, RECORD, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First record of each key, -1 for those that the shard doesn't hold."""
        keys = np.asarray(keys, np.int64)
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = place(keys[left], level, int(size) * BITS)
            blocks = self.rows(int(self.levels_at[level]), BLOCK, at // BITS)
            bits, row = np.unpackbits(blocks["bits"], axis=1), np.arange(len(at))
            hit = bits[row, at % BITS].astype(bool)
            rank = blocks["rank"] + np.cumsum(bits, axis=1, dtype=np.int64)[row, at % BITS] - 1
            slot[left[hit]] = rank[hit]
            left = left[~hit]
            if not len(left):
                break
        known = np.flatnonzero(slot >= 0)
        got = self.rows(self.slots_at, SLOT, slot[known])
        same = got["print"] == fingerprints(keys[known])
        known, first = known[same], got["record"][same].astype(np.int64)
        # The record itself settles the one in 2**32 foreign keys that share a fingerprint.
        own = self.records(first)["id"] == keys[known]
        out = np.full(len(keys), -1, np.int64)
        out[known[own]] = first[own]
        return out

    def limits(self, at: np.ndarray) -> np.ndarray:
        """Start and end of each record's ids, in ids."""
        ends = np.append(self.records(np.minimum(at + 1, self.n - 1))["start"], 0)[:-1]
        return np.stack((self.records(at)["start"], np.where(at + 1 < self.n, ends, self.n_ids)), 1)

    def payload(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.payloads.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def lookup(self, key: int) -> list[np.ndarray]:
        """Ids of each document with this id."""
        r, out = int(self.find(np.array([key]))[0]), []
        while 0 <= r < self.n:
            record = self.records(np.array([r]))[0]
            if record["id"] != key or record["null"]:
                break
            out.append(self.payload(*self.limits(np.array([r]))[0].tolist()))
            r += 1
        return out


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# Encoding

#: What the shortcuts of Encoder rest on, as a tokenizer's file says it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Encoder:
    """Ids of texts by the tokenizers library. A tokenizer with the normalizers and pieces above has
    no piece across a space, tab or line end, so each chunk between those is encoded once and kept.
    A chunk that is all letters once normalised is one piece, whose last token alone is marked as a
    word's end; so many such chunks are encoded in one call, and sentence marks after one are a
    piece of their own. All other chunks, and the texts of any other tokenizer, are encoded whole."""

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        says = json.loads(self.tokenizer.to_str())
        self.chunked = (says["normalizer"] or {}).get("normalizers") == NORMALIZERS and ((says["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0] == PIECES and says["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.size = 0

    def whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(got.ids, f"<u{self.width}").tobytes() for got in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def letters(self, chunks: list[str], step: int = 512) -> None:
        """Chunks that are one piece each."""
        groups = [chunks[k : k + step] for k in range(0, len(chunks), step)]
        for got, group in zip(self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), groups, strict=True):
            ids = np.array(got.ids, f"<u{self.width}")
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.width
            if len(ends) != len(group):  # the library knows other letters than Python
                self.known.update(zip(group, self.whole(group), strict=True))
                continue
            data = ids.tobytes()
            self.known.update(zip(group, (data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)), strict=True))

    def learn(self, new: set[str]) -> None:
        marked, cores, others = [], set(), set()
        for c in new:
            core = c.rstrip(self.MARKS)
            if not self.one_piece(core):
                others.add(c)
                continue
            low = core.lower() if core.isascii() else core
            cores.add(low)
            if low != c:
                marked.append((c, low, c[len(core) :]))
                others.add(c[len(core) :])
        known = self.known
        self.letters(sorted(cores.difference(known)))
        others = sorted(others.difference(known))
        known.update(zip(others, self.whole(others), strict=True))
        known.update({c: known[low] + known[tail] for c, low, tail in marked})
        self.size += sum(200 + 2 * len(c) for c in new)

    @staticmethod
    def one_piece(core: str) -> bool:
        """Whether the core's normalised form is letters alone. Normalising and lower-casing can leave
        combining marks, which are pieces, with what follows, of their own."""
        return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as words of `width` bytes."""
        if not self.chunked:
            return self.whole(texts)
        if self.size > MOST_KEPT:
            self.known.clear()
            self.size = 0
        get, out, late, new = self.known.get, [], [], set()
        for k, t in enumerate(texts):
            chunks = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            got = list(map(get, chunks))
            if None in got:
                new |= set(chunks).difference(self.known)
                late.append((k, chunks))
                out.append(b"")
            else:
                out.append(b"".join(got))
        if new:
            self.learn(new)
            for k, chunks in late:
                out[k] = b"".join(map(self.known.__getitem__, chunks))
        return out


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return kept(("token_ids", path), lambda: Encoder(path))


def groups(batches, least: int = 1 << 20):
    """Ids and texts of rows, about 1 MB of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= least:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) below folder; gives the manifest, a row a shard, with `start`."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    # A shard an input split, so shards keep their size as the corpus grows.
    shards = min(MOST_SHARDS, shards or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        from pyspark import TaskContext

        path, enc = f"{folder}/shard-{uuid.uuid4().hex}", encoder(tokenizer)
        end = np.array([END_ID], f"<u{enc.width}").tobytes()
        ids, sizes, out, fs = [], [], None, None
        for group, texts in groups(batches):
            if out is None:
                fs, name = file_system(path)
                fs.create_dir(os.path.dirname(name), recursive=True)
                out = fs.open_output_stream(name + ".ids")
            got = [x + end for x in enc.encode(texts)]
            out.write(b"".join(got))
            ids += group
            sizes += [len(x) // enc.width for x in got]
        if out is None:
            return
        out.close()
        null = np.array([i is None for i in ids])
        limits = np.concatenate(([0], np.cumsum(sizes)))
        with fs.open_output_stream(name + ".idx") as f:
            f.write(write_index(np.array([i or 0 for i in ids], np.int64), null, limits[:-1], int(limits[-1]), enc.width))
        real = [i for i in ids if i is not None] or [None]
        yield pa.record_batch({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(limits[-1])], pa.int64()), "first_id": pa.array([real[0]], pa.int64()), "last_id": pa.array([real[-1]], pa.int64())})

    # The text's start splits a doc_id that many rows share.
    keys = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()
    rows = docs.select("doc_id", "text").repartitionByRange(shards, *keys).sortWithinPartitions(keys[0], F.col("text").asc_nulls_first())
    manifest = Scratch(spark, "token-ids").put(rows.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row a document, read from the files through the index. place: of its first id in the shard."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from documents(row)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(run, READ)


def documents(row: dict, step: int = 1024):
    with Shard(row["path"]) as s:
        every = s.records(np.arange(s.n))
        nulls = int(every["null"].sum())
        keys, counts = np.unique(every["id"][nulls:], return_counts=True)
        for a in range(0, nulls, step):
            yield summed(s, row, np.full(min(step, nulls - a), -1), np.arange(a, min(nulls, a + step)))
        for a in range(0, len(keys), step):
            first = s.find(keys[a : a + step])
            if (first < 0).any():
                raise ValueError(f"{row['path']}: the index misses a key")
            many = counts[a : a + step]
            of = np.repeat(np.arange(len(first)), many)
            at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            for k in range(0, len(at), step):
                yield summed(s, row, keys[a + of[k : k + step]], at[k : k + step])


def summed(s: Shard, row: dict, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of the documents whose records are `at`, which lie close together."""
    limits = s.limits(at)
    low = int(limits[:, 0].min())
    data = s.payload(low, int(limits[:, 1].max())).astype("<u4")
    sums = [zlib.crc32(data[x - low : y - low]) for x, y in limits.tolist()]
    null = s.records(at)["null"].astype(bool)
    return pa.record_batch({
        "doc_id": pa.array(keys, pa.int64(), mask=null), "start": pa.array(row["start"] + limits[:, 0], pa.int64()), "n_tokens": pa.array(limits[:, 1] - limits[:, 0], pa.int64()),
        "ids_crc32": pa.array(sums, pa.int64()), "shard": pa.array([row["shard"]] * len(at), pa.int64()), "place": pa.array(limits[:, 0], pa.int64()),
    })


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document whose doc_id is among keys(doc_id): each key goes to the
    shards whose limits hold it, and is found there through the index by a few short reads."""
    spark = manifest.sparkSession
    limits = manifest.where("first_id is not null").select("shard", "first_id", "last_id").orderBy("shard").toArrow()
    shards, first, last = (limits[c].to_numpy() for c in ("shard", "first_id", "last_id"))

    def send(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            a, b = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            many = np.maximum(b - a, 0)
            at = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.record_batch({"doc_id": pa.array(np.repeat(ids, many), pa.int64()), "shard": pa.array(shards[at], pa.int64())})

    def read(batches):
        shard, path = None, None
        try:
            for batch in batches:
                ids, out = [], []
                for key, where in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                    if where != path:
                        if shard:
                            shard.__exit__()
                        shard, path = Shard(where), where
                    for found in shard.lookup(key):
                        ids.append(key)
                        out.append(found.tolist())
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(out, pa.list_(pa.int64()))})
        finally:
            if shard:
                shard.__exit__()

    sent = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().mapInArrow(send, "doc_id long, shard long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.join(manifest.select("shard", "path"), "shard").repartition(n, "shard").sortWithinPartitions("path", "doc_id").select("doc_id", "path").mapInArrow(read, "doc_id long, ids array<long>")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = Scratch(docs.sparkSession, "token-ids").path("shards")
    return read_shards(write_shards(docs, folder, tokenizer))
