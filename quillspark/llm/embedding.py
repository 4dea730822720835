"""Embedding near-dedup by NN-descent (Dong et al., 2011).

1. Vectors are normalised in double precision; equal ones become one node with a multiplicity.
2. First lists: orders by random hyperplane codes, each cut into runs of LEAF nodes, in which all
   are compared and each keeps its k nearest. Their number grows with the table, so that a pair at
   the threshold is likely to share a run however many nodes there are (`orders`).
3. Descent: at each node the nodes on its list, and a bounded draw of those that list it, are
   compared with one another; what beats the worst of a list enters it. A list whose every entry
   passes the threshold is saturated, and doubles for the next round. Rounds end when few entries
   change.
4. Lists guide the search but are no source of links: each set of nodes that was compared, in runs
   and in the descent, gives a spanning forest of its pairs that pass the threshold, so no pair that
   was ever compared is lost to a list's length. Inside each component of the forests' edges all
   members are compared with all, block by block: the number of links is exact there, however dense
   the component.
5. Recall is audited after the search: a table of probes, one node in PROBE_EVERY by hash, at least
   LEAST_PROBES and at most PROBES, is compared with all nodes in blocks. A linked probe's recall
   counts once, whatever the number of its links, and the probes with few links and those with many
   must each reach the aim. Where they don't, 2 to 4 run again over other orders with longer lists;
   after the last go all nodes are compared with all in blocks. Where no probe has links there is
   nothing to measure and the search stands: its orders are as many as lose a pair at the threshold
   with a probability of MISS, however rare links are. `last_audit` has the figures.

Results for odd rows: null and empty vectors, zero vectors and those with null or non-finite
components have no links and a component of their own; vectors of different lengths have no cosine
and don't link: runs, blocks and probes hold one length each, so that all lengths, however many, are
searched together; rows with equal ids are nodes of one component; equal vectors, however many, are
one node; an empty table gives no rows; columns other than vec_id and embedding are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

THRESHOLD, NEIGHBOURS, LEAF, ORDERS, BLOCK, AIM, ROUNDS, GOES = 0.9, 6, 128, 3, 256, 0.98, 4, 3
#: Bits of a code; nodes in a block of the audit and of the exact search; links that are few.
BITS, EXACT, FEW = 30, 1024, 8
#: Probability that no order brings a pair at the threshold together.
MISS = 0.01
#: One node in so many is a probe of the audit; the least and the most of them.
PROBE_EVERY, LEAST_PROBES, PROBES = 50, 256, 16384
#: entry: of a list; else an edge of a forest.
EDGE = "a long, b long, sim double, entry boolean"


def matrix(column) -> np.ndarray:
    """Rows of a list column, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def usable(rows: DataFrame) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0))


def normalised(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, x in by_length(batch.column("embedding")) if batch.num_rows else ():
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                at = pa.array(at)
                yield pa.record_batch({"rep": batch.column("rep").take(at), "many": batch.column("many").take(at), "x": as_lists(x)})

    return reps.mapInArrow(run, "rep long, many long, x array<double>")


def by_length(column):
    """(places, matrix) of the rows of each length in a list column."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, matrix(column if len(at) == len(sizes) else column.take(pa.array(at)))


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))


def nearest(ids: np.ndarray, x: np.ndarray, k: np.ndarray | int, floor: np.ndarray | None = None):
    """Entries (a, b, sim) among the given nodes: the k nearest of each, above its floor."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    if floor is not None:
        sims[sims <= floor[:, None]] = -2
    most = min(int(np.max(k)), len(ids) - 1)
    if most <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    top = np.argpartition(-sims, most - 1, 1)[:, :most]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), 1, kind="stable"), 1)
    got = np.take_along_axis(sims, top, 1)
    keep = (got > -2) & (np.arange(most)[None, :] < np.broadcast_to(np.asarray(k), len(ids))[:, None])
    return np.repeat(ids, keep.sum(1)), ids[top[keep]], got[keep]


def forest(ids: np.ndarray, sims: np.ndarray, threshold: float):
    """Edges (a, b, sim) of a spanning forest of the pairs among the given nodes that pass."""
    hit = sims >= threshold
    np.fill_diagonal(hit, False)
    left, a, b = hit.any(1), [], []
    while left.any():
        front = np.array([np.argmax(left)])
        left[front] = False
        while len(front):
            reach = hit[front]
            new = np.flatnonzero(reach.any(0) & left)
            a.append(front[reach[:, new].argmax(0)])
            b.append(new)
            left[new] = False
            front = new
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b = np.concatenate(a), np.concatenate(b)
    return ids[a], ids[b], sims[a, b]


def entries(parts, forests) -> pa.RecordBatch:
    a, b, s = (np.concatenate([p[i] for p in [*parts, *forests]]) for i in range(3))
    entry = np.arange(len(a)) < sum(len(p[0]) for p in parts)
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64()), "entry": pa.array(entry)})


def orders(n: int, threshold: float, miss: float = MISS) -> int:
    """Orders after which a pair at the threshold has shared no run with probability `miss`: it
    shares the code's first bits, as many as part n nodes into runs, and a run's ends part some."""
    same = 0.7 * (1 - np.arccos(threshold) / np.pi) ** max(0.0, np.log2(max(n, 1) / LEAF))
    return max(ORDERS, int(np.ceil(np.log(miss) / np.log(1 - same))))


def first_lists(scratch: Scratch, nodes: DataFrame, parts: int, k: int, go: int, many: int, threshold: float) -> DataFrame:
    """k nearest, and forests, in each run of LEAF nodes of one length of `many` random orders."""

    def coded(s: int):
        def run(batches):
            for batch in batches:
                for at, x in by_length(batch.column("x")) if batch.num_rows else ():
                    p = x @ np.random.default_rng(s).standard_normal((x.shape[1], BITS + 1))
                    code = ((p[:, :BITS] > 0) << np.arange(BITS)).sum(1)
                    place = pa.array(code + 1 / (1 + np.exp(-4 * p[:, BITS])), pa.float64())
                    yield batch.take(pa.array(at)).append_column("place", place)

        return nodes.select("rep", "d", "x").mapInArrow(run, "rep long, d int, x array<double>, place double")

    def leaf(ids, x):
        return entries([nearest(ids, x, k)], [forest(ids, x @ x.T, threshold)])

    def leaves(batches):
        ids, x = np.empty(0, np.int64), None
        for batch in batches:
            for at, new in by_length(batch.column("x")) if batch.num_rows else ():
                if len(ids) and x.shape[1] != new.shape[1]:
                    yield leaf(ids, x)
                    ids = ids[:0]
                x = np.concatenate((x, new)) if len(ids) else new
                ids = np.concatenate((ids, batch.column("rep").to_numpy()[at]))
                while len(ids) >= 2 * LEAF:
                    yield leaf(ids[:LEAF], x[:LEAF])
                    ids, x = ids[LEAF:], x[LEAF:]
        if len(ids) > 1:
            yield leaf(ids, x)

    out = None
    for t in range(many):
        # Written one by one, so that the disk holds the shuffle of one order at a time.
        sorted_ = coded(go * 1000 + t).repartitionByRange(parts, "d", "place").sortWithinPartitions("d", "place")
        got = scratch.put(sorted_.mapInArrow(leaves, EDGE), f"order{go}-{t}")
        out = got if out is None else out.union(got)
    return out


def best(edges: DataFrame, wanted: DataFrame | None, k: int) -> DataFrame:
    """The lists: each node's nearest, as many as it wants."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    if wanted is None:
        return edges.withColumn("r", rank).where(F.col("r") <= k).drop("r")
    return edges.join(wanted, "a", "left").withColumn("r", rank).where(F.col("r") <= F.coalesce("wants", F.lit(k))).drop("r", "wants")


def descend(nodes: DataFrame, lists: DataFrame, wanted: DataFrame, parts: int, k: int, seed: int, threshold: float) -> DataFrame:
    """Entries better than the lists', and forests, from comparing each node's neighbours with one another."""
    draw = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(seed))))
    back = lists.withColumn("d", draw).where(F.col("d") <= k).select(F.col("b").alias("m"), F.col("a").alias("v"))
    own = lists.withColumn("d", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("d") <= k).select(F.col("a").alias("m"), F.col("b").alias("v"))
    around = own.union(back).union(nodes.select(F.col("rep").alias("m"), F.col("rep").alias("v"))).distinct()
    state = nodes.select(F.col("rep").alias("v"), "d", "x").join(wanted.select(F.col("a").alias("v"), "wants", "worst"), "v", "left")
    met = around.join(state, "v").select("m", "v", "d", "x", F.coalesce("wants", F.lit(k)).alias("wants"), F.coalesce("worst", F.lit(-1.0)).alias("worst"))

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            m = t["m"].to_numpy()
            whole = int(np.searchsorted(m, m[-1]))
            rest = t.slice(whole)
            if whole:
                yield compared(t.slice(0, whole))
        if rest is not None:
            yield compared(rest)

    def compared(t: pa.Table) -> pa.RecordBatch:
        m, v, wants, worst = t["m"].to_numpy(), t["v"].to_numpy(), t["wants"].to_numpy(), t["worst"].to_numpy()
        edge = np.concatenate((np.flatnonzero(np.diff(m, prepend=m[0] - 1)), [len(m)]))
        cuts = list(zip(edge[:-1], edge[1:], strict=True))
        one = len(np.unique(t["d"].to_numpy())) == 1
        whole = matrix(t["x"]) if one else None
        xs = [whole[a:b] if one else matrix(t["x"].slice(a, b - a)) for a, b in cuts]
        return entries([nearest(v[a:b], x, wants[a:b], worst[a:b]) for (a, b), x in zip(cuts, xs, strict=True)], [forest(v[a:b], x @ x.T, threshold) for (a, b), x in zip(cuts, xs, strict=True)])

    return met.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(run, EDGE)


def link_counts(nodes: DataFrame, parts: DataFrame, threshold: float, n: int) -> DataFrame:
    """(rep, linked): rows that each member's links inside its component stand for."""
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    placed = parts.withColumnRenamed("node", "rep").join(sizes, "component").join(nodes, "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    left = placed.select(F.col("component").alias("key"), F.col("chunk").alias("i"), each.alias("j"), "rep", "many", "x")
    right = placed.select(F.col("component").alias("key"), each.alias("i"), F.col("chunk").alias("j"), "rep", "many", "x")
    return met_counts(left, right, threshold, n)


def met_counts(left: DataFrame, right: DataFrame, threshold: float, n: int) -> DataFrame:
    """(rep, linked): rows that the left nodes' links among the right ones of their blocks (key, i, j)
    stand for."""
    keys = ["key", "i", "j"]

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cut = breaks(t)
            rest = t.slice(cut[-1])
            if cut[-1]:
                yield counted(t.slice(0, cut[-1]))
        if rest is not None:
            yield counted(rest)

    def breaks(t: pa.Table) -> list[int]:
        k = np.stack([t[c].to_numpy() for c in keys], 1)
        return [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]

    def counted(t: pa.Table) -> pa.RecordBatch:
        cut = [*breaks(t), t.num_rows]
        rep, many, side = t["rep"].to_numpy(), t["many"].to_numpy(), t["left"].to_numpy()
        ids, sums = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x = matrix(t["x"].slice(a, b - a))
            l, r = np.flatnonzero(side[a:b]), np.flatnonzero(~side[a:b])
            hit = (x[l] @ x[r].T >= threshold) & (rep[a + l][:, None] != rep[a + r][None, :])
            ids.append(rep[a + l])
            sums.append(hit @ many[a + r])
        return pa.record_batch({"rep": pa.array(np.concatenate(ids), pa.int64()), "linked": pa.array(np.concatenate(sums), pa.int64())})

    met = left.withColumn("left", F.lit(True)).union(right.withColumn("left", F.lit(False))).repartition(n, *keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


# Tables of a row a length are broadcast: joined by key, all nodes of a length, with their vectors, would
# meet in one task and be copied there for all their blocks.

def exact_links(nodes: DataFrame, threshold: float, n: int) -> DataFrame:
    """Forest edges (a, b) from comparing all nodes of a length with all, two blocks of EXACT nodes at
    a time."""
    sizes = nodes.groupBy("d").agg(F.ceil(F.count("*") / EXACT).alias("chunks"))
    rows = nodes.join(F.broadcast(sizes), "d")
    met = rows.select("d", "rep", "x", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
    met = met.select("d", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "rep", "x")

    def run(batches):
        key, ids, xs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in "dij"], 1)
            rep = batch.column("rep").to_numpy()
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if tuple(k[a]) != key and ids:
                    yield whole(ids, xs)
                    ids, xs = [], []
                key = tuple(k[a])
                ids.append(rep[a:b])
                xs.append(matrix(batch.column("x").slice(a, b - a)))
        if ids:
            yield whole(ids, xs)

    def whole(ids, xs) -> pa.RecordBatch:
        x = np.concatenate(xs)
        return entries([], [forest(np.concatenate(ids), x @ x.T, threshold)])

    return met.repartition(n, "d", "i", "j").sortWithinPartitions("d", "i", "j").mapInArrow(run, EDGE).select("a", "b")


def probes_of(nodes: DataFrame, n: int) -> DataFrame:
    """The audit's probes: nodes by the hash of their ids, so that reruns take the same. Only ids, at most
    PROBES a task, are sorted and sent to one; vectors stay where they are."""
    first = nodes.select("rep").orderBy(F.xxhash64("rep"), "rep").limit(min(PROBES, max(LEAST_PROBES, n // PROBE_EVERY)))
    return nodes.join(F.broadcast(first), "rep", "left_semi")


def true_links(nodes: DataFrame, probes: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(rep, linked) of the probes by brute force over all nodes of their lengths, in blocks."""
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    asked = probes.groupBy("d").agg(F.ceil(F.count("*") / EXACT).alias("asked"))
    blocks = nodes.join(F.broadcast(asked.select("d")), "d", "left_semi").groupBy("d").agg(F.ceil(F.count("*") / EXACT).alias("blocks")).join(asked, "d")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = probes.join(F.broadcast(blocks), "d").withColumn("chunks", F.col("asked")).select(F.col("d").cast("long").alias("key"), chunk.alias("i"), each("blocks").alias("j"), "rep", "many", "x")
    right = nodes.join(F.broadcast(blocks), "d").withColumn("chunks", F.col("blocks")).select(F.col("d").cast("long").alias("key"), each("asked").alias("i"), chunk.alias("j"), "rep", "many", "x")
    return met_counts(left, right, threshold, parts).where("linked > 0")


def audited(truth: DataFrame, counts: DataFrame) -> dict[str, tuple[int, float]]:
    """Linked probes and their mean recall, for those with few links and those with many."""
    kind = F.when(F.col("linked") < FEW, "few").otherwise("many").alias("kind")
    both = truth.join(counts.select("rep", F.col("linked").alias("have")), "rep", "left")
    got = both.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.coalesce("have", F.lit(0)) / F.col("linked")).alias("recall")).collect()
    return {r["kind"]: (r["n"], r["recall"]) for r in got}


def exact(scratch: Scratch, nodes: DataFrame, threshold: float, parts: int):
    """(groups, counts) from comparing all nodes of a length with all."""
    groups = scratch.put(components(scratch, scratch.put(exact_links(nodes, threshold, parts), "exact")), "exact-groups")
    return groups, scratch.put(link_counts(nodes, groups, threshold, parts), "exact-counts")


def search(scratch: Scratch, nodes: DataFrame, n: int, most: int, threshold: float, k: int, parts: int, go: int, links: DataFrame | None) -> DataFrame:
    """Links (a, b, sim, entry) of one go of NN-descent over n nodes, at most `most` of a length, with
    those of earlier goes."""
    first = first_lists(scratch, nodes, parts, k, go, orders(most, threshold), threshold)
    lists = scratch.put(best(first.where("entry"), None, k), f"lists{go}-0")
    raw = first if links is None else first.union(links)
    for r in range(ROUNDS):
        # A list whose every entry passes is saturated: it doubles for the next round, each round.
        size = F.count("*")
        full = F.when((F.min("sim") >= threshold) & (size >= k), 2 * size).otherwise(F.lit(k))
        wanted = lists.groupBy("a").agg(full.alias("wants"), F.when(size >= full, F.min("sim")).otherwise(-1.0).alias("worst"))
        got = scratch.put(descend(nodes, lists, wanted, parts, k, r, threshold), f"found{go}-{r}")
        raw = raw.union(got)
        new = got.where("entry").count()
        if not new:
            break
        lists = scratch.put(best(lists.union(got.where("entry").drop("entry")), wanted.select("a", "wants"), k), f"lists{go}-{r + 1}")
        if new < 0.02 * n * k:
            break
    return scratch.put(raw.where("not entry").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1.0).alias("sim"), "entry").distinct(), f"links{go}")


#: Figures of the latest audit in this process, one for each go: what `audited` gives.
last_audit: list[dict[str, tuple[int, float]]] = []


def linked(scratch: Scratch, nodes: DataFrame, threshold: float, k: int, parts: int):
    """(groups, counts): (node, component) and (rep, linked)."""
    size = nodes.groupBy("d").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()[0]
    n, truth, links = size["n"] or 0, None, None
    last_audit.clear()
    for go in range(GOES):
        links = search(scratch, nodes, n, size["most"] or 0, threshold, k * 2**go, parts, go, links)
        groups = scratch.put(components(scratch, links.select("a", "b")), f"groups{go}")
        counts = scratch.put(link_counts(nodes, groups, threshold, parts), f"counts{go}")
        if truth is None:
            truth = scratch.put(true_links(nodes, scratch.put(probes_of(nodes, n), "probes"), threshold, parts), "truth")
        last_audit.append(audited(truth, counts))
        if all(recall >= AIM for _, recall in last_audit[-1].values()):
            return groups, counts
    return exact(scratch, nodes, threshold, parts)


def embedding_duplicates(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of rows(vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "embedding")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    classes = scratch.put(usable(rows).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    nodes = scratch.put(normalised(classes).withColumn("d", F.size("x")), "nodes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())
    groups, counts = linked(scratch, nodes, threshold, k, parts)
    own = classes.select("embedding", "rep", "many").join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    own = own.select("embedding", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    out = rows.join(own, "embedding", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
