"""Context-tree weighting of bytes as a language model.

Every byte is decomposed into its eight bits, most significant first, so that a byte
context has a binary tree of 255 nodes, each with the numbers of zeros and ones seen
there in the whole corpus.  Contexts are the last 0, 1, ... ``depth`` bytes (zero bytes stand
before a text's beginning).  A node's Krichevsky-Trofimov estimate has the
probability Pe of its counts; its weighted probability is ``Pw = Pe / 2 + prod(Pw of the
contexts one byte longer) / 2``, and ``Pw = Pe`` at the greatest depth.

No byte is explained by itself: the probability of a bit is ``Pw`` of the whole corpus over ``Pw`` of the corpus
without that one occurrence, at the empty context.  As Pe doesn't depend on an order, this is the sequential code
length of the bit when it comes last, after all others, its own document's included.
It mixes, by the weights of the depths, the estimates (c - 1/2) / n of a bit seen c times in n at each node.
The code length of a byte is the sum over its bits, that of a text the sum over its bytes; reported per byte.

What is gathered grows with the corpus.  A gram is a byte with ``depth`` bytes of context, the last
byte first, so that grams of a context at any depth lie together.  Texts are written to the shared
folder in slices of at most ``SLICE`` bytes, with each slice's distinct grams and counts as compressed
runs, one for each hash bucket of the last three bytes; there is about a bucket for each ``BUCKET_BYTES`` of the
table.  A bucket has whole subtrees from the third
byte on: one aggregation by bucket gives what depths 0 to 2 need of them (at most 65,536 contexts whatever the corpus, finished on the
driver), a second the code length of every gram, which goes back to the slices that have it and is
joined with their texts.  No task holds the whole tree.  Texts are handled as Arrow's byte
buffers in numpy, without a Python object for a text.

Defined results.  Null and empty texts have no bytes: their code length is 0 and that per
byte is null; every row is in the result.  Repeated rows count, and are scored, one by one; equal texts have equal
code lengths.  Texts longer than a slice are a slice of their own, scored whole.  doc_id must be an integer.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, planned_bytes, table, tidy

#: Bytes of context; a gram of seven bytes is a long.
DEPTH = 6
SLICE = 32 << 20
BUCKET_BYTES = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
#: Bytes handled at a time.
BLOCK = 2 << 20


def buffers(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) in blocks of whole texts; col: large or plain string."""
    col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
        end = min(end, n)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after shifting x to 10 or more."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def nodes(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the 255 nodes of each context, (contexts, 255): the node of the bits read so far, as a heap."""
    zeros, ones = np.zeros((len(byte_counts), 255)), np.zeros((len(byte_counts), 255))
    for bit in range(8):
        below = byte_counts.reshape(len(byte_counts), 1 << bit, 2, -1).sum(3)
        at = slice((1 << bit) - 1, (2 << bit) - 1)
        zeros[:, at], ones[:, at] = below[:, :, 0], below[:, :, 1]
    return zeros, ones


def grams(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """last byte, the one before it, ... to depth, and the byte itself, at each place; starts: first places of the texts."""
    out = data.astype(np.int64)
    since = np.zeros(len(data), np.int64)
    inside = starts[starts < len(data)]
    since[inside] = inside
    since = np.arange(len(data)) - np.maximum.accumulate(since)
    for d in range(1, depth + 1):
        back = np.zeros(len(data), np.int64)
        back[d:] = data[:-d]
        back[since < d] = 0
        out |= back << (8 * (depth + 1 - d))
    return out


def add_up(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of each."""
    key, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *sums])
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(n[order], cut) if len(key) else n


def distinct(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams(data, off[:-1], depth))
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[cut], np.diff(np.concatenate([cut, [len(g)]]))


def bucket_of(gram: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return (((gram >> (8 * (depth - 2))) * 0x9E3779B1 & 0xFFFFFFFF) * buckets >> 32).astype(np.int32)


def squeeze(gram: np.ndarray, n: np.ndarray) -> bytes:
    """Rising grams as differences, and counts, by planes of bytes."""
    both = np.concatenate([np.diff(gram, prepend=0), n]).astype("<i8")
    return pa.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(pa.decompress(blob, decompressed_size=16 * n, codec="zstd", asbytes=True), np.uint8)
    both = np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(both[:n]), both[n:]


def sliced(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows (slice, doc_id, text) and, with a bucket, (slice, bucket, size, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["slice", "doc_id", "text", "bucket", "size", "grams"]
        at, held, keys, sums = TaskContext.get().partitionId() << 32, 0, [], []

        def finish() -> pa.RecordBatch:
            gram, n = add_up(keys, sums)
            bucket = bucket_of(gram, depth, buckets)
            order = np.argsort(bucket, kind="stable")
            gram, n, bucket = gram[order], n[order], bucket[order]
            cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(gram)]
            blobs = [squeeze(gram[a:b], n[a:b]) for a, b in zip(cut, cut[1:])]
            k = len(blobs)
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(bucket[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array(blobs, pa.binary())], names=names
            )

        for b in batches:
            for first, end, data, off in buffers(b.column(1)):
                if held and held + len(data) > SLICE:
                    yield finish()
                    at, held, keys, sums = at + 1, 0, [], []
                if len(data):
                    k, n = distinct(data, off, depth)
                    keys.append(k)
                    sums.append(n)
                    if len(keys) == 8:
                        k, n = add_up(keys, sums)
                        keys, sums = [k], [n]
                    held += len(data)
                k = end - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * k, pa.int64()), b.column(0).slice(first, k), b.column(1).slice(first, k).cast(pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names
                )
        if held:
            yield finish()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "slice long, doc_id long, text string, bucket int, size int, grams binary")


def log_kt_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log_kt of whole numbers: small ones from tables."""
    if not len(a):
        return np.zeros(0)
    most = int(min(max(a.max(), b.max()) + 1, 1 << 14))
    half, whole = log_gamma(np.arange(most) + 0.5), log_gamma(np.arange(2 * most) + 1.0)
    low = (a < most) & (b < most)
    x, y = np.where(low, a, 0), np.where(low, b, 0)
    out = half[x] + half[y] - whole[x + y] - np.log(np.pi)
    if not low.all():
        out[~low] = log_kt(a[~low], b[~low])
    return out


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, code: bool) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """From distinct grams, rising, with whole subtrees from depth 3.

    With ``code``: one over the probability of each bit of each gram by depths 3 and more, (8, grams).  Without:
    (two bytes of context << 8 | node, log Pw) of the nodes at depth 3.
    """
    # level by level, deepest first: entries (context, byte) with counts, and the place of each one's parent
    levels, keys, num = [], gram, n
    for d in range(depth, 2, -1):
        parent, up = None, None
        if d > 3:
            short = (keys >> 16 << 8) | (keys & 255)
            parent, up = np.unique(short, return_inverse=True)
        levels.append((keys, num, up))
        if d > 3:
            keys, num = parent, np.bincount(up, num, len(parent)).astype(np.int64)
    sums, inverse = [], np.zeros((8, len(gram)) if code else 0)
    for bit in range(8):
        log_pw, parent_node, path, low = None, None, np.arange(len(gram)), None
        one = ((gram >> (7 - bit)) & 1).astype(bool)
        for keys, num, up in levels:
            prefix = keys >> (8 - bit)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            start, node = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.add.reduceat(num, start)
            o = np.add.reduceat(num * ((keys >> (7 - bit)) & 1), start)
            pe = log_kt_counts(total - o, o)
            if code:
                at = node[path]
                here = total[at] / (np.where(one, o[at], total[at] - o[at]) - 0.5)
            if log_pw is None:
                log_pw = pe
                low = here if code else None
            else:
                product = np.bincount(node[parent_node], log_pw, len(start))
                if code:
                    own = 1 / (1 + np.exp(-np.clip(pe - product, -700, 700)))[at]
                    low = own * here + (1 - own) * low
                log_pw = np.log(0.5) + np.logaddexp(pe, product)
            if up is not None:
                parent_node = up[start]  # a place of the parent level, whose node it belongs to
                path = up[path]
            elif not code:
                k = keys[start]
                sums.append(((k >> 16 << 8) | ((1 << bit) - 1 + ((k & 255) >> (8 - bit))), log_pw))
        if code:
            inverse[bit] = low
    return inverse if code else (np.concatenate([x[0] for x in sums]), np.concatenate([x[1] for x in sums]))


def top(key: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts of two bytes, a, b): one over the probability of a bit x is a[x] + b times that by the longer contexts; a: (2, contexts, 255), b: (contexts, 255).

    key: last byte << 8 | the one before; value: the sum of log Pw one byte deeper at node, or the count of the byte node - 256.
    """
    ctx = np.unique(key)
    row, counted = np.searchsorted(ctx, key), node >= 256
    deep, product2 = np.zeros((len(ctx), 256)), np.zeros((len(ctx), 255))
    deep[row[counted], node[counted] - 256] = value[counted]
    product2[row[~counted], node[~counted]] = value[~counted]
    last = ctx >> 8
    mid = np.zeros((256, 256))
    np.add.at(mid, last, deep)
    share = lambda beta: 1 / (1 + np.exp(-np.clip(beta, -700, 700)))
    inverse = lambda z, o: np.stack([(z + o) / (z - 0.5), (z + o) / (o - 0.5)])  # noqa: E731  of a bit that was seen
    product1, a, b = np.zeros((256, 255)), np.zeros((2, len(ctx), 255), np.float32), np.zeros((len(ctx), 255), np.float32)
    for at in range(0, len(ctx), 2048):
        z, o = nodes(deep[at : at + 2048])
        pe = log_kt(z, o)
        p = product2[at : at + 2048]
        np.add.at(product1, last[at : at + 2048], np.log(0.5) + np.logaddexp(pe, p))
        own = share(pe - p)
        a[:, at : at + 2048], b[at : at + 2048] = own * inverse(z, o), 1 - own
    z1, o1 = nodes(mid)
    pe1 = log_kt(z1, o1)
    z0, o0 = nodes(mid.sum(0)[None])
    own1 = share(pe1 - product1)
    own0 = share(log_kt(z0, o0) - (np.log(0.5) + np.logaddexp(pe1, product1)).sum(0)[None])
    inverse0, inverse1 = own0 * inverse(z0, o0), own1 * inverse(z1, o1)
    for at in range(0, len(ctx), 2048):
        here = last[at : at + 2048]
        a[:, at : at + 2048] = inverse0 + (1 - own0) * (inverse1[:, here] + (1 - own1)[here] * a[:, at : at + 2048])
        b[at : at + 2048] *= (1 - own0) * (1 - own1)[here]
    return ctx, a, b


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, code_bits, bits_per_byte) for every row, by the model of all of them; depth: 3 to 6 bytes of context."""
    if not 3 <= depth <= DEPTH:
        raise ValueError("depth must be from 3 to 6")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, planned_bytes(docs) // BUCKET_BYTES))
    written = materialize(sliced(docs, depth, buckets), "slices")
    grams_of = written.filter("bucket IS NOT NULL").select("slice", "bucket", "size", "grams")

    def gathered(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        runs = [unsqueeze(blob, size) for blob, size in zip(t.column("grams").to_pylist(), t.column("size").to_pylist(), strict=True)]
        return [r[0] for r in runs], *add_up([r[0] for r in runs], [r[1] for r in runs])

    def sums(t: pa.Table) -> pa.Table:
        _, gram, n = gathered(t)
        at, value = subtrees(gram, n, depth, code=False)
        at, where = np.unique(at, return_inverse=True)
        value = np.bincount(where, value, len(at))
        byte = (gram >> (8 * (depth - 1)) << 8) | (gram & 255)
        byte, where = np.unique(byte, return_inverse=True)
        key = np.concatenate([at >> 8, byte >> 8]).astype(np.int32)
        node = np.concatenate([at & 255, 256 + (byte & 255)]).astype(np.int32)
        return pa.table({"key": key, "node": node, "value": np.concatenate([value, np.bincount(where, n, len(byte))])})

    found = grams_of.groupBy("bucket").applyInArrow(sums, "key int, node int, value double").groupBy("key", "node").agg(F.sum("value").alias("value")).toArrow()  # depths 0 to 2: bounded whatever the corpus
    shipped = docs.sparkSession.sparkContext.broadcast(top(*(found.column(i).to_numpy() for i in range(3))))

    def lengths(t: pa.Table) -> pa.Table:
        ctx, a, b = shipped.value
        runs, gram, n = gathered(t)
        inverse = subtrees(gram, n, depth, code=True)
        row, byte, bits = np.searchsorted(ctx, gram >> (8 * (depth - 1))), gram & 255, np.zeros(len(gram))
        for bit in range(8):
            node = (1 << bit) - 1 + (byte >> (8 - bit))
            bits += np.log2(a[(byte >> (7 - bit)) & 1, row, node] + b[row, node] * inverse[bit])
        bits = bits.astype("<f4")
        return pa.table({"slice": t.column("slice"), "bucket": t.column("bucket"), "bits": pa.array([bits[np.searchsorted(gram, r)].tobytes() for r in runs], pa.binary())})

    bits_of = grams_of.groupBy("bucket").applyInArrow(lengths, "slice long, bucket int, bits binary")

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        blocks = [x for chunk in texts.column("text").chunks for x in buffers(chunk)]
        keys, none = [], []
        for _, _, data, off in blocks:
            if len(data):
                k, _ = distinct(data, off, depth)
                keys.append(k)
                none.append(np.zeros(len(k), np.int64))
                if len(keys) == 8:
                    k, z = add_up(keys, none)
                    keys, none = [k], [z]
        gram, _ = add_up(keys, none)
        order = np.argsort(bucket_of(gram, depth, buckets), kind="stable")
        found = found.sort_by("bucket")
        cost = np.zeros(len(gram))
        cost[order] = np.frombuffer(b"".join(found.column("bits").to_pylist()), "<f4")
        size, bits = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, _, data, off in blocks:
            size.append(np.diff(off))
            bits.append(np.zeros(len(off) - 1))
            if len(data):
                g = grams(data, off[:-1], depth)
                by = np.argsort(g)
                each = np.empty(len(g))
                each[by] = cost[np.searchsorted(gram, g[by])]
                full = np.flatnonzero(np.diff(off))
                bits[-1][full] = np.add.reduceat(each, off[full])
        size, bits = np.concatenate(size), np.concatenate(bits)
        per = pa.array(np.where(size > 0, bits / np.maximum(size, 1), np.nan), mask=size == 0)
        tidy()
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": size, "code_bits": bits, "bits_per_byte": per})

    texts = written.filter("bucket IS NULL").select("slice", "doc_id", "text")
    return texts.groupBy("slice").cogroup(bits_of.groupBy("slice")).applyInArrow(run, "doc_id long, n_bytes long, code_bits double, bits_per_byte double")


def op4_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
