"""MinHash near-dedup with SetSketch registers (Ertl, 2021).

A text's set is its distinct 5-word shingles. Register i is floor(1 - log_b(x)) of the smallest of
the exponential variates x that hash i gives the set's elements, clipped to 16 bits: exponentially
spaced, truncated minima, which merge by maximum and agree between two sets about as often as
their Jaccard similarity says (b = 1.001).

1. Texts with equal sets form a class; only its smallest doc_id goes on.
2. Four registers make a band; two classes that agree in one of the 32 bands are in a bucket
   together. At similarity 0.75 a pair misses all bands with probability 5e-6.
3. Each member of a bucket is compared with the bucket's smallest (a star, so a bucket costs its
   size): by set sizes, by the likelihood of their registers, then on the full sets.
4. A bucket whose members have not all come together through these links may hide links between
   others. There, members of different components are compared with one another, in blocks of two
   chunks of the bucket: by the likelihood of their registers, then on full sets, likeliest first,
   until linked. Chunks are bounded by members and by the hashes in their sets.
5. Components of all confirmed links.

Hot buckets: sizes never matter in 2 and 3 beyond their sum, and joins on bucket keys can be split
by adaptive execution; 4 touches only buckets that disagree.

Shingles count as equal where their 64-bit hashes are: two of a pair's n shingles clash with
probability n*n / 2**65. Classes of equal sets are told apart by 128 bits and the set's size.

Results for odd rows: texts without words (or null) have an empty set, no links, and stay alone;
rows with equal ids are one node, linked by what any of the rows holds; n_shingles stays per row;
null ids are left alone with a null component; texts of any length are one row; an empty table
gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, release
from .hashing import LOWER, inside, mix, spans, window_hashes, word_hashes

SHINGLE, REGISTERS, ROWS = 5, 128, 4
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Pairs of a lower estimate are not compared on full sets. Its standard error at 0.75 is 0.038, so
#: that 1 in 10**7 links is below it.
LEAST_ESTIMATE = 0.55
#: Registers, of 128, that agree in a pair whose likelihood is computed: at similarity 0.75 it is 96 on
#: average, with a deviation of 4.9, so that 7 in 10**13 links have fewer.
LEAST_SAME = 61
#: Members of a chunk, and hashes in the sets of one, on average: a block of two has some MB.
CHUNK, CHUNK_HASHES = 1024, 1 << 19
#: Pairs of a block whose likelihoods are computed at once.
STEP = 4096
SEEDS = np.random.default_rng(5).integers(0, 2**32, (REGISTERS, 2), dtype=np.uint32) | np.uint32(1)
SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = spans(data)
    limits = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(limits, starts, "right")
    words = word_hashes(data, starts, ends)
    at = np.flatnonzero(inside(owner, SHINGLE))
    hashes, of = window_hashes(words, SHINGLE)[at], owner[at]
    cut, word_cut = np.searchsorted(of, np.arange(len(texts) + 1)), np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        a, b = word_cut[k], word_cut[k + 1]
        if 0 < b - a < SHINGLE:
            out.append(window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.unique(hashes[cut[k] : cut[k + 1]]))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set, none of which is empty."""
    every = np.concatenate(sets)
    small = (every >> np.uint64(32)).astype(np.uint32)
    edge = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    low = np.empty((len(sets), REGISTERS), np.uint32)
    for i, (a, b) in enumerate(SEEDS):
        v = (small ^ b) * a
        v ^= v >> np.uint32(15)
        low[:, i] = np.minimum.reduceat(v * np.uint32(0x85EBCA6B), edge)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / log(BASE)) + 2**15, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair of rows, given the set sizes (Ertl, section 3.2)."""
    up, down = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0) for n, x in ((up, more), (down, less), (REGISTERS - up - down, 1 - more - less))]
    return np.take_along_axis(j, sum(terms).argmax(1)[:, None], 1)[:, 0]


def text_groups(batches, least: int = 1 << 20):
    release()
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= least:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def sketches(docs: DataFrame) -> DataFrame:
    """For each row its set's size, a 128-bit digest of the set, and the registers by bands."""

    def run(batches):
        for ids, texts in text_groups(batches):
            sets = shingle_sets(texts)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(sets), REGISTERS // ROWS), np.int64)
            if full:
                r = registers([sets[k] for k in full])
                bands[full] = r.view(np.int64)
            total = lambda c: pa.array(np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))  # noqa: B023, E731
            yield pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "s1": total(0x51ED270B), "s2": total(0xC2B2AE3D27D4EB4F),
                "bands": pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), REGISTERS // ROWS).cast(pa.list_(pa.int64())),
            })

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for ids, texts in text_groups(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts)]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h array<long>")


def likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) whose estimate leaves a link possible."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS)  # noqa: B023, E731
            sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb")]
            keep = pa.array(estimate(rows("ra"), rows("rb"), *sizes) >= LEAST_ESTIMATE)
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, na long, nb long")


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of distinct pairs (a, b) of classes: by size, by registers, on full sets."""
    of = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("bands").alias(f"r{s}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    have = lambda s: sets.select(F.col("rep").alias(s), F.col("h").alias(f"h{s}"))
    both = likely(sized).join(have("a"), "a").join(have("b"), "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where("100 * both >= 75 * (na + nb - both)").select("a", "b")


def cross_links(placed: DataFrame, odd: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that share an odd bucket.

    A bucket's members are dealt to chunks, and each two chunks meet in a block of bounded size. A
    block compares registers as arrays and gives confirmed links alone, never pairs; a pair that
    shares several bands is looked at in the first of them; likely pairs come first, and pairs that
    links found in the block already connect are skipped."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside_ = placed.select("band", "key", "rep", "part").join(odd, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    met = inside_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select("band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "part")
    full = met.join(reps.select("rep", "bands"), "rep").join(sets, "rep")
    keys = ["band", "key", "i", "j"]

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            k = np.stack([t[c].to_numpy() for c in keys], 1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield block_links(t.slice(a, b - a))
            rest = t.slice(cut[-1])
        if rest is not None:
            yield block_links(rest)

    return full.repartition(n, *keys).sortWithinPartitions(*keys, "rep").select(*keys, "chunk", "rep", "part", "bands", "h").mapInArrow(run, "a long, b long")


def block_links(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    rep, part, chunk, band = t["rep"].to_numpy(), t["part"].to_numpy(), t["chunk"].to_numpy(), t["band"][0].as_py()
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    hashes, regs = [x.values.to_numpy() for x in t["h"].combine_chunks()], bands.view(np.uint16).reshape(len(rep), -1)
    size = np.array([len(x) for x in hashes])
    left, right = np.flatnonzero(chunk == t["i"][0].as_py()), np.flatnonzero(chunk == t["j"][0].as_py())
    xs, ys, score = [], [], []
    for x in left:
        y = right[right > x] if t["i"][0].as_py() == t["j"][0].as_py() else right
        y = y[(part[y] != part[x]) & (100 * np.minimum(size[y], size[x]) >= 75 * np.maximum(size[y], size[x]))]
        y = y[(bands[y] == bands[x]).argmax(1) == band]
        same = (regs[y] == regs[x]).sum(1)
        y = y[same >= LEAST_SAME]
        likely_ = np.concatenate([estimate(regs[[x]], regs[part_], size[[x]].astype(np.float64), size[part_].astype(np.float64)) for part_ in np.split(y, range(STEP, len(y), STEP))]) if len(y) else np.empty(0)
        y, likely_ = y[likely_ >= LEAST_ESTIMATE], likely_[likely_ >= LEAST_ESTIMATE]
        xs.append(np.full(len(y), x))
        ys.append(y)
        score.append(likely_)
    out, parent = [], {}

    def root(p):
        while p in parent:
            p = parent[p]
        return p

    if xs:
        xs, ys, score = np.concatenate(xs), np.concatenate(ys), np.concatenate(score)
        for k in np.argsort(-score, kind="stable"):
            x, y = xs[k], ys[k]
            p, q = root(part[x]), root(part[y])
            if p == q:
                continue
            both = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
            if 100 * both >= 75 * (size[x] + size[y] - both):
                parent[max(p, q)] = min(p, q)
                out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
    return pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    rows = scratch.put(sketches(docs), "rows")
    real = rows.where("n > 0 and doc_id is not null")
    reps = scratch.put(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), *[F.first("bands").alias("bands")]), "reps")

    banded = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    lead = banded.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = scratch.put(banded.join(lead, ["band", "key"]), "members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = full_sets(docs.join(needed, "doc_id", "left_semi"))
    # Rows with one id and several texts: the class's own set is the one of its digest's size.
    sets = scratch.put(sets.withColumn("n", F.size("h")).join(reps.select(F.col("rep").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi").select(F.col("doc_id").alias("rep"), "h"), "sets")

    star = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.put(confirmed(star, reps, sets), "links")
    parts = scratch.put(components(scratch, links), "parts")

    part = lambda c: F.coalesce(F.col(c), F.col(c.replace("part_", "")))
    by = lambda s: parts.select(F.col("node").alias(s), F.col("component").alias(f"part_{s}"))
    placed = members.join(by("rep"), "rep", "left").join(by("lead"), "lead", "left").select("band", "key", "rep", "n", part("part_rep").alias("part"), part("part_lead").alias("main"))
    odd = placed.groupBy("band", "key").agg(F.count("*").alias("c"), F.sum("n").alias("hashes"), F.max((F.col("part") != F.col("main")).cast("int")).alias("odd")).where("odd = 1")
    odd = scratch.put(odd.select("band", "key", F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("hashes") / CHUNK_HASHES)).alias("chunks")), "odd")
    more = None
    if odd.limit(1).count():
        more = scratch.put(cross_links(placed, odd, reps, sets).distinct(), "more")
    # Rows of one id with several sets are one node too, through that id.
    own = reps.select("s1", "s2", "n", "rep")
    classes = real.select("doc_id", "s1", "s2", "n").join(own, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    extra = parts.select(F.col("component").alias("a"), F.col("node").alias("b"))
    every = extra.union(more) if more is not None else extra
    repeats = real.groupBy("doc_id").agg(F.count_distinct("s1", "s2", "n").alias("k")).where("k > 1").select("doc_id")
    if more is not None or repeats.limit(1).count():
        if repeats.limit(1).count():
            every = every.union(classes)
        parts = scratch.put(components(scratch, every), "all")
    scratch.drop("members", "sets", "links", "odd", "more")
    label = own.join(by2(parts), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(label, ["s1", "s2", "n"], "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), found).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def by2(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("rep"), "component")
