"""Counting fingerprints over a whole corpus by blocks of texts and buckets of fingerprints.

A block is a few MB of texts, chosen by a digest of the row. Each block sends its distinct
fingerprints, as packed slices, to the buckets that share the fingerprint range evenly; a bucket
answers each slice with packed bits or values in the slice's order, and the block, computed again,
lays them over its own fingerprints. A block sends a fingerprint once, however often its texts
repeat it, so a passage that a third of all rows hold costs a bucket one entry a block. No task
gets more than a block or a bucket. Each step is a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

BLOCK_MB, LEAST = 2, 64
SLICE = "bucket long, block long, n long, payload binary"
LAST_ID = 2**63 - 1


class Blocks:
    def __init__(self, docs: DataFrame, carry: list[str] = ()):
        """carry: columns of docs that come back with each row in `finish`."""
        size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
        #: Blocks grow with the corpus too, so that slices stay longer than their overhead.
        mb = min(16, max(BLOCK_MB, (size / 2**20 / 1024) ** 0.5))
        self.n = max(LEAST, -(-size // int(mb * 2**20)))
        self.carry = list(carry)
        rows = docs.select("doc_id", "text", *self.carry, F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(self.n)).alias("block"))
        self.kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        #: Rows move in packs: those of a batch for one block, compressed together.
        self.docs = rows.mapInArrow(packs, "block long, pack binary")

    def send(self, make) -> DataFrame:
        """Slices of make(block's texts), which gives sorted distinct uint64 and per-slice bytes."""
        n = self.n

        def run(table: pa.Table) -> pa.Table:
            return sliced(n, int(table["block"][0].as_py()), *make(Texts(table)))

        return self.docs.groupBy("block").applyInArrow(run, SLICE)

    def send_with(self, answers: DataFrame, make) -> DataFrame:
        n = self.n

        def run(table: pa.Table, found: pa.Table) -> pa.Table:
            return sliced(n, int(table["block"][0].as_py()), *make(Texts(table), Answers(found, n)))

        return self.docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SLICE)

    def finish(self, answers: DataFrame, make, schema: str) -> DataFrame:
        """make(texts, answers) gives the result's columns for each block."""
        n, out, carry = self.n, arrow_schema(schema), self.carry
        kinds = self.kinds
        schema += "".join(f", {c} {kinds[c]}" for c in carry)

        def run(table: pa.Table, found: pa.Table) -> pa.Table:
            texts = Texts(table)
            made = pa.table(make(texts, Answers(found, n)), schema=out)
            for c in carry:
                made = made.append_column(c, texts.table[c].take(texts.order))
            return made

        return self.docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def packs(batches):
    """Each batch's rows by block, as a compressed Arrow stream a block."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        rows = batch.drop_columns(["block"])
        edge = np.flatnonzero(np.diff(blocks[order], prepend=-1)) if len(order) else []
        out = []
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            part = rows.take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                w.write_batch(part)
            out.append(sink.getvalue().to_pybytes())
        yield pa.record_batch({"block": pa.array(blocks[order][edge] if len(order) else [], pa.int64()), "pack": pa.array(out, pa.binary())})


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n under 2**32, of each key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def first_key(bucket: int, n: int) -> int:
    """The smallest key that falls into a bucket, of n."""
    return -(-(bucket << 32) // n) << 32


def runs(keys: np.ndarray, n: int):
    """(bucket, from, to) of each bucket that sorted keys fall into: work and slices are bounded by
    the keys, not by the number of buckets."""
    of = buckets(keys, n)
    cut = [*np.flatnonzero(np.diff(of)) + 1]
    return zip(of[[0, *cut]].astype(np.int64).tolist(), [0, *cut], [*cut, len(keys)], strict=True) if len(keys) else ()


def sliced(n: int, block: int, keys: np.ndarray, pack) -> pa.Table:
    found = [(k, b - a, pack(a, b)) for k, a, b in runs(keys, n)]
    at, sizes, payloads = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"bucket": pa.array(at, pa.int64()), "block": pa.array([block] * len(at), pa.int64()), "n": pa.array([int(x) for x in sizes], pa.int64()), "payload": pa.array(payloads, pa.binary())})


def answer(slices: DataFrame, work) -> DataFrame:
    """work(payloads, sizes) gives a payload, or None for 'nothing', for each slice of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        got = work(table["payload"].to_pylist(), table["n"].to_pylist())
        keep = [k for k, x in enumerate(got) if x is not None]
        return table.select(["bucket", "block", "n"]).take(pa.array(keep, pa.int64())).append_column("payload", pa.array([got[k] for k in keep], pa.binary()))

    return slices.groupBy("bucket").applyInArrow(run, SLICE)


class Texts:
    """A block's rows in the order of doc_id and text, the same whatever order they arrive in.
    A null id comes last and counts as greater than all others."""

    def __init__(self, packs: pa.Table):
        release()
        # Answers come from blocks with texts alone, so no block is without packs.
        table = self.table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs["pack"].to_pylist()])
        ids, texts = table["doc_id"].to_pylist(), [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.order = pa.array(order, pa.int64())
        self.numbers = np.array([LAST_ID if i is None else i for i in self.ids], np.int64)


class Answers:
    def __init__(self, table: pa.Table, n: int):
        self.rows = dict(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True)) if table.num_rows else {}
        self.n = n

    def only(self, wanted, change=lambda k: k):
        """The answers whose bucket is wanted, under another number."""
        out = object.__new__(Answers)
        out.rows, out.n = {change(k): v for k, v in self.rows.items() if wanted(k)}, self.n
        return out

    def slices(self, keys: np.ndarray):
        """(from, to, payload) for each answered slice of the keys."""
        for k, a, b in runs(keys, self.n):
            if k in self.rows:
                yield a, b, self.rows[k]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for lo, hi, payload in self.slices(keys):
            out[lo:hi] = np.unpackbits(np.frombuffer(payload, np.uint8), count=hi - lo)
        return out


def repeated(payloads: list[bytes], sizes: list[int], width: int = 8) -> list[bytes | None]:
    """Of slices of keys (width bytes each) followed by a bit each for 'repeats in the block':
    the bits of the keys that repeat in their block or stand in two blocks."""
    keys = [unpacked(p[: n * width], width) for p, n in zip(payloads, sizes, strict=True)]
    flags = np.concatenate([np.unpackbits(np.frombuffer(p[n * width :], np.uint8), count=n).astype(bool) for p, n in zip(payloads, sizes, strict=True)])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    twin = np.zeros(len(every), bool)
    twin[1:] |= same
    twin[:-1] |= same
    flags[order] |= twin
    at = np.cumsum([0, *sizes])
    return [np.packbits(x).tobytes() if x.any() else None for x in (flags[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]


def packed(keys: np.ndarray, width: int) -> bytes:
    """The keys' highest `width` bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")
