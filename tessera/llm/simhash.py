"""SimHash near-duplicate removal with pivot distance tables.

* Fingerprint: 128 sign bits over the set of a text's words (runs of letters and digits in
  lower case).  Two texts are near duplicates if their fingerprints differ in at most
  ``K`` bits, which for a text with a share r of its words replaced is about
  128 * acos(1 - r) / pi.
* First candidates: pairs that agree in all of ``b`` sampled bits of one of ``T`` tables.  Both numbers follow from
  the number of distinct fingerprints alone, by one rule at every size (``plan_tables``): ``b`` is such that a bucket has about
  ``BUCKET_ROWS`` of them, and ``T`` such that a pair at distance ``K`` meets with probability ``RECALL``
  if the bits in which they differ are any; nearer pairs meet more often.  Work grows with about the power 1.3 of the number at K = 22.
* Pivot distance tables: inside a bucket, each of the 8 16-bit segments of a fingerprint has its precomputed Hamming
  distances to 8 reference values, 64 in all.  By the triangle inequality the largest difference
  of a coordinate bounds the distance of the segments from below, and the sum over
  segments that of the fingerprints: pairs whose bound exceeds ``K`` are discarded.
* Verify: the exact distance of the survivors.
* The rest, exactly: the tables leave out a few pairs, so every pair of fingerprints of different groups is then ruled out or
  linked.  The 128 bits are cut into segments with radii that sum to ``K`` less the number of segments but one: a pair within ``K`` is within the radius
  in one segment at least.  So all values within the radius of a fingerprint's own are looked up for each segment (``crossing``), and
  what is found is compared exactly.  All pairs of chunks of fingerprints are tiles, a task each.  Work grows with the square of
  the number of distinct fingerprints, and is about a hundredth of that of comparing all of them.

Equal fingerprints are one node from the start, and a bucket sends on a spanning
forest of its verified pairs, not all of them, so groups of thousands of copies cost
no more than their size in rows.  A bucket most of whose rows are connected by now compares only the others
with all of it, so buckets full of near copies aren't quadratic.  No bucket, group or partner list is capped.  Groups are the connected
components, found by alternating large-star and small-star rounds over tables in
the shared folder.  The document with the smallest doc_id of a group stays.

Defined results.  Texts without words (null, empty, punctuation) and rows of null
doc_id are compared with nothing and stay.  Rows that share a doc_id are one
document: they fall into one group, and of those whose doc_id stays one row does
(any, if they differ).  Ties cannot occur: doc_ids of distinct documents differ.  Words of texts of any length
count, each once.  doc_id must be an integer.
Extra columns are kept by ``filter_documents`` under any name and ignored by
``duplicate_pairs``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, own_columns, own_name, table, tidy

K = 22
BUCKET_ROWS = 16
RECALL = 0.95
SEGMENTS, REFERENCES = 8, 8
SEED = 20240607
#: Fingerprints on a side of a tile at most, and how many are looked up and how many pairs compared at a time; members in a tile from which a group's own are passed over.
CHUNK, BLOCK, PAIRS, CROWD = 1 << 20, 1 << 15, 1 << 17, 64
U = np.uint64


def plan_tables(n: int, k: int = K) -> tuple[int, int]:
    """(bits of a key, tables) for n distinct fingerprints."""
    bits = max(8, round(math.log2(max(n, 1) / BUCKET_ROWS)))
    together = math.comb(128 - k, bits) / math.comb(128, bits)
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-together)))


def sampled_bits(bits: int, tables: int) -> np.ndarray:
    """(128, tables): the value that each bit of a fingerprint adds to the key of each table."""
    rng, out = np.random.default_rng(SEED), np.zeros((128, tables))
    for t in range(tables):
        out[rng.choice(128, bits, replace=False), t] = 2.0 ** np.arange(bits)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def simhash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2) uint64 from the word hashes of document i in hashes[offsets[i]:offsets[i + 1]]; none may be empty."""
    n = len(offsets) - 1
    counts = np.zeros((n, 128), np.int32)
    step = 1 << 15  # words at a time
    at = int(offsets[0])
    while at < offsets[-1]:
        end = min(at + step, int(offsets[-1]))
        h = hashes[at:end].view(np.uint64)
        bits = np.unpackbits(np.stack([mix(h), mix(h + U(0x9E3779B97F4A7C15))], 1).view(np.uint8).reshape(-1, 16), axis=1)
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
        cuts = np.maximum(offsets[first:last], at) - at
        counts[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        at = end
    sizes = np.diff(offsets)[:, None]
    return np.packbits(2 * counts > sizes, axis=1).view(np.uint64)


def signs(fp: np.ndarray) -> np.ndarray:
    """(n, 128) of +1 and -1."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 16), axis=1).astype(np.float32) * 2 - 1


def references() -> np.ndarray:
    """(segments, bits of one, references) of +1 and -1."""
    return np.random.default_rng(SEED + 1).choice(np.array([-1, 1], np.float32), (SEGMENTS, 128 // SEGMENTS, REFERENCES))


def coordinates(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """(segments, n, references): distances of the segments to their reference values."""
    out = np.empty((SEGMENTS, len(fp), REFERENCES), np.int8)
    for at in range(0, len(fp), 8192):
        s = signs(fp[at : at + 8192]).reshape(-1, SEGMENTS, 128 // SEGMENTS)
        for g in range(SEGMENTS):
            out[g, at : at + 8192] = (128 // SEGMENTS - s[:, g] @ refs[g]) / 2
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def near(i: np.ndarray, j: np.ndarray, fp: np.ndarray, coords: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows i, j that are within k: first by the bound of the pivot distances, then exactly."""
    bound = np.zeros(len(i), np.int16)
    for g in range(SEGMENTS):
        c = coords[g]
        bound = bound + np.abs(c[i] - c[j]).max(1)
        on = bound <= k
        i, j, bound = i[on], j[on], bound[on]
        if not len(i):
            return i, j
    on = distance(fp[i], fp[j]) <= k
    return i[on], j[on]


def forest(keys: np.ndarray, fp: np.ndarray, refs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of the components of rows with equal keys and distance <= k; keys are sorted.

    The rows i and i + s are compared for s = 1, 2, ... in all buckets at once.  Pairs whose rows are connected by
    then needn't be.  At s = 8, 32, 128, ... buckets of which three quarters are one component are finished: the other
    rows are compared with all of theirs.
    """
    n = len(keys)
    root = np.arange(n)
    coords = None
    left = np.arange(n)
    s, check = 0, 8

    def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def connect(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        if not len(i):
            return
        parent = root
        while len(i):
            a, b = find(parent, i), find(parent, j)
            on = a != b
            i, j, a, b = i[on], j[on], a[on], b[on]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        root = find(parent, np.arange(n))

    def finish(first: int, end: int) -> bool:
        of = root[first:end]
        value, count = np.unique(of, return_counts=True)
        odd = first + np.flatnonzero(of != value[count.argmax()])
        if 4 * len(odd) > end - first:
            return False
        step = max(1, (1 << 20) // (end - first))
        for at in range(0, len(odd), step):
            some = odd[at : at + step]
            i, j = np.repeat(some, end - first), np.tile(np.arange(first, end), len(some))
            on = root[i] != root[j]
            connect(*near(i[on], j[on], fp, coords, k))
        return True

    while True:
        s += 1
        left = left[left + s < n]
        left = left[keys[left] == keys[left + s]]
        if not len(left):
            break
        if coords is None:
            coords = coordinates(fp, refs)
        if s == check:
            check *= 4
            names = np.unique(keys[left])
            starts, ends = np.searchsorted(keys, names), np.searchsorted(keys, names, "right")
            big = ends - starts > 8 * s
            done = [key for key, first, end in zip(names[big], starts[big].tolist(), ends[big].tolist(), strict=True) if finish(first, end)]
            left = left[~np.isin(keys[left], done)]
        i = left[root[left] != root[left + s]]
        connect(*near(i, i + s, fp, coords, k))
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def cut_segments(k: int, rows: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the segments with the least work for ``rows`` fingerprints on a side; a comparison costs half a lookup.

    The radii plus one sum to k + 1: a pair beyond the radius in every segment differs in more than k bits.
    """

    def cut(parts: int) -> list[tuple[int, int, int]]:
        ends = [128 * g // parts for g in range(parts + 1)]
        return [(a, b - a, (k + 1) // parts - 1 + (g < (k + 1) % parts)) for g, (a, b) in enumerate(pairwise(ends))]

    def work(cuts: list[tuple[int, int, int]]) -> float:
        return sum(math.comb(bits, d) * (1 + rows / 2**bits / 2) for _, bits, radius in cuts for d in range(radius + 1))

    return min((cut(parts) for parts in range(6, 13)), key=work)


def segment(fp: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The values of the bits first, ..., first + bits - 1 of each fingerprint."""
    out = np.empty(len(fp), np.int32)
    for at in range(0, len(fp), 8192):
        on = np.unpackbits(np.ascontiguousarray(fp[at : at + 8192]).view(np.uint8).reshape(-1, 16), axis=1)
        out[at : at + 8192] = on[:, first : first + bits] @ (1 << np.arange(bits))
    return out


def crossing(a: np.ndarray, of_a: np.ndarray, b: np.ndarray | None, of_b: np.ndarray | None, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u > v: the pairs of groups of which fingerprints, one of ``a`` and one of ``b``, are within k; without ``b``, both of ``a``.

    ``of_a`` and ``of_b`` are the groups; pairs of fingerprints of one group are passed over.
    """
    alone = b is None
    if alone:
        b, of_b = a, of_a
    groups, rank = np.unique(np.concatenate([of_a, of_b]), return_inverse=True)
    rank_a, rank_b = rank[: len(a)], rank[len(rank) - len(b) :]
    crowded = np.bincount(rank_b, minlength=len(groups)) >= CROWD
    links: list[np.ndarray] = []
    for first_bit, bits, radius in cut_segments(k, len(b)):
        if radius < 0:
            continue
        value, other = segment(a, first_bit, bits), segment(b, first_bit, bits)
        order = np.lexsort((rank_b, other))
        other, group_b, (high_b, low_b) = other[order], rank_b[order], b[order].T.copy()
        place = other.astype(np.int64) << 32 | group_b
        counts = np.bincount(other, minlength=1 << bits).astype(np.int32)
        starts = np.cumsum(counts) - counts
        order = np.lexsort((rank_a, value))
        value, group_a, (high_a, low_a) = value[order], rank_a[order], a[order].T.copy()
        masks = [sum(1 << x for x in on) for d in range(min(radius, bits) + 1) for on in combinations(range(bits), d)]
        for at in range(0, len(a), BLOCK):
            block = value[at : at + BLOCK]
            crowd = crowded[group_a[at : at + BLOCK]]
            some = crowd.any()
            # of a pair of values that differ in the lowest bit of a mask, one looks up the other
            rows = [np.flatnonzero(block >> x & 1 == 0) for x in range(bits)] if alone else []
            values = [block[i] for i in rows]
            found = []
            for mask in masks:
                lowest = (mask & -mask).bit_length() - 1
                key = (values[lowest] if alone and mask else block) ^ np.int32(mask)
                count = counts[key]
                on = np.flatnonzero(count)
                if not len(on):
                    continue
                key, count = key[on], count[on].astype(np.int64)
                i = rows[lowest][on] if alone and mask else on
                start = starts[key]
                if some and len(on := np.flatnonzero(crowd[i] & (count >= CROWD))):  # before and after their own group
                    own = key[on].astype(np.int64) << 32 | group_a[at + i[on]]
                    here, beyond = np.searchsorted(place, own), np.searchsorted(place, own + 1)
                    i, start, count = np.append(i, i[on]), np.append(start, beyond), np.append(count, start[on] + count[on] - beyond)
                    count[on] = here - start[on]
                    on = np.flatnonzero(count)
                    i, start, count = i[on], start[on], count[on]
                i = i + at
                ends = np.cumsum(count)
                done = 0
                while done < len(i):
                    before = int(ends[done - 1]) if done else 0
                    to = max(done + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
                    n = count[done:to]
                    x = np.repeat(i[done:to], n)
                    y = np.arange(before, int(ends[to - 1])) + np.repeat(start[done:to] - ends[done:to] + n, n)
                    done = to
                    on = np.flatnonzero(np.bitwise_count(high_a[x] ^ high_b[y]) <= k)
                    x, y = x[on], y[on]
                    on = np.bitwise_count(high_a[x] ^ high_b[y]) + np.bitwise_count(low_a[x] ^ low_b[y]) <= k
                    u, v = group_a[x[on]], group_b[y[on]]
                    on = u != v
                    if on.any():
                        found.append(np.maximum(u, v)[on] << 32 | np.minimum(u, v)[on])
            if found:
                links.append(np.unique(np.concatenate(found)))
    both = np.unique(np.concatenate(links)) if links else np.empty(0, np.int64)
    return groups[both >> 32], groups[both & 0xFFFFFFFF]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of the rows that have a doc_id and words."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), hashes.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            full = np.diff(col.offsets.to_numpy()) > 0
            if not full.any():
                continue
            b = b.filter(pa.array(full))
            col = b.column(1)
            off = col.offsets.to_numpy().astype(np.int64)
            fp = simhash(col.values.to_numpy(zero_copy_only=False), off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))], names=["doc_id", "hi", "lo"])

    return rows.mapInArrow(run, "doc_id long, hi long, lo long")


def bucket_rows(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, hi, lo, node) for each table; the sampled bits are drawn anew from their seed by each task."""
    wide = np.int32 if tables << bits < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sampled_bits(bits, tables)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                hi, lo, node = (b.column(i).slice(at, 2048).to_numpy(zero_copy_only=False) for i in range(3))
                on = np.unpackbits(np.stack([hi, lo], 1).view(np.uint8).reshape(-1, 16), axis=1)
                key = (on @ values).astype(np.int64) + (np.arange(tables) << bits)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(wide)), *(pa.array(np.repeat(x, tables)) for x in (hi, lo, node))], names=["key", "hi", "lo", "node"])
        tidy()

    return nodes.mapInArrow(run, f"key {'int' if wide is np.int32 else 'long'}, hi long, lo long, node long")


def bucket_edges(rows: DataFrame, k: int = K) -> DataFrame:
    """(u, v), u > v, of a spanning forest of the verified pairs of each bucket."""

    def solve(held: list[pa.RecordBatch], refs: np.ndarray) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, hi, lo, node = (t.column(i).to_numpy() for i in range(4))
        a, b = forest(key, np.stack([hi, lo], 1).view(np.uint64), refs, k)
        u, v = node[a], node[b]
        on = u != v
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)[on]), pa.array(np.minimum(u, v)[on])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, held, size = references(), [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < 100_000:
                continue
            keys = b.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut == 0 and len({int(x.column(0)[0].as_py()) for x in held}) == 1:
                continue  # one bucket so far
            if cut == 0:  # the last bucket began in an earlier batch
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.searchsorted(t.column(0).to_numpy(), keys[-1]))
                yield solve([t.slice(0, cut)], refs)
                held = [t.slice(cut)]
            else:
                yield solve([*held[:-1], b.slice(0, cut)], refs)
                held = [b.slice(cut)]
            size = sum(x.num_rows for x in held)
        if held:
            yield solve(held, refs)
        del held, refs
        tidy()

    return rows.repartition("key").sortWithinPartitions("key", "hi").mapInArrow(run, "u long, v long").distinct()


def crossing_edges(rooted: DataFrame, n: int, k: int = K) -> DataFrame:
    """(u, v), u > v: the pairs of groups that a verified pair links, of the n rows (hi, lo, root) of fingerprints and their groups so far."""
    cores = rooted.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(n / CHUNK), min(math.ceil(math.sqrt(4 * cores)), math.ceil(n / 4096)))
    tiles = chunks * (chunks + 1) // 2
    one, two = F.least("chunk", "other"), F.greatest("chunk", "other")
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") == one, 1).otherwise(2)
    rows = rooted.withColumn("chunk", F.pmod(F.xxhash64("hi", "lo"), F.lit(chunks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    rows = rows.select((F.floor(two * (two + 1) / 2) + one).cast("int").alias("tile"), side.cast("byte").alias("side"), "hi", "lo", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            del held
            tile, side, hi, lo, root = (t.column(i).to_numpy() for i in range(5))
            fp = np.stack([hi, lo], 1).view(np.uint64)
            for x in np.unique(tile):
                at = [np.flatnonzero((tile == x) & (side == s)) for s in range(3)]
                if len(at[0]):
                    u, v = crossing(fp[at[0]], root[at[0]], None, None, k)
                else:
                    u, v = crossing(fp[at[1]], root[at[1]], fp[at[2]], root[at[2]], k)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        tidy()

    return rows.repartitionById(tiles, "tile").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) but the roots; the root is the smallest node of its component."""
    spark = edges.sparkSession

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = mark(now)
    while state[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        # minima are half found before the shuffle, and a hub's rows can be split when they come back to it
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.*").filter("u <> v").distinct(), "edges")
        drop(spark, now)
        now, before = after, state
        state = mark(now)
        if state == before:
            break
    return now.toDF("node", "root")


def _groups(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, kept_doc_id) of each document that goes, fingerprints)."""
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "nodes")
    # documents of one doc_id are one node
    same = fps.join(nodes, ["hi", "lo"]).filter("doc_id <> node").select(F.greatest("doc_id", "node").alias("u"), F.least("doc_id", "node").alias("v"))
    n = nodes.count()
    rows = bucket_rows(nodes.repartition(max(1, spark.sparkContext.defaultParallelism), "hi"), *plan_tables(n, k))
    roots = components(bucket_edges(rows, k).union(same))
    rooted = nodes.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))
    more = materialize(crossing_edges(rooted, n, k), "more")
    drop(spark, nodes)
    if not more.isEmpty():
        joined = components(more)
        to = joined.toDF("root", "to")
        roots = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(joined)
    drop(spark, more)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id")), fps


def duplicate_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that goes, with the one of its group that stays."""
    pairs, fps = _groups(docs, k)
    drop(docs.sparkSession, fps)
    return pairs


def filter_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """One document of each group, with all its columns."""
    gone, fps = _groups(docs, k)
    gone = materialize(gone.select("doc_id"), "gone")
    twice = materialize(fps.groupBy("doc_id").count().filter("count > 1").select("doc_id").join(gone, "doc_id", "left_anti"), "twice")
    drop(docs.sparkSession, fps)
    key = own_name(docs, "gone")
    away = gone.union(twice).toDF(key)
    once = docs.join(away, F.col("doc_id") == F.col(key), "left_anti").select(own_columns(docs))
    if twice.isEmpty():
        return once
    return once.union(docs.join(twice.toDF(key), F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id"]).select(own_columns(docs)))


def op5_simhash_dedup(spark, sf_dir):
    return duplicate_pairs(table(spark, sf_dir, "documents"))
