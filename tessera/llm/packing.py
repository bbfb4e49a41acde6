"""Best-fit packing of documents into sequences by the linear grouping scheme.

A document's tokens are its UTF-8 bytes and one separator.  Documents longer than a
sequence's ``capacity`` are cut into full sequences and a rest, so no token is lost.
All that is left to plan depends only on *how many* pieces of each length there are,
and lengths run from 1 to ``capacity``: the plan is made on the driver from a histogram
of at most ``capacity`` rows, whatever the number of documents.

1. Pieces longer than ``eps * capacity`` are large.  In falling order they are cut into
   ``groups`` of equal cardinality, each rounded up to its largest length.
2. The few sizes are packed by configurations: the linear program over all
   configurations is solved by column generation (revised simplex, pricing by an
   exact bounded search), rounded down, and the rest is packed first-fit.
3. The actual pieces take the places of their group, in runs of equal length.
4. Small pieces go, longest first, to the fullest sequence they fit; best fit over
   classes of sequences of equal room.  New sequences are opened when none has room.

The plan is a list of runs (length, ranks) -> sequences.  Pieces get their rank among
those of their length from a range sort with per-partition counts, so no length
is gathered in one task, and find their run by binary search.

``pack_in_order`` keeps an order of training.  The rows of its input, in their order, lie end to end; pieces are
planned, as above, within consecutive stretches of ``STRETCH`` sequences' tokens, each by one task, and
sequences are numbered by stretch and then by the mean position of their pieces.  Equal lengths are
ranked by position.  A copy of a piece that would share a sequence with another is moved to the fullest other
sequence of its stretch with room, or to a new one.

Defined results.  A null or empty text is its separator alone: every row is in the
result.  Texts of any length are cut, none is dropped.  doc_id must be an integer or null.  Repeated rows are packed one by one.  Equal lengths are ranked by doc_id (nulls
first), piece, and position.  Full pieces have sequences of their own.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 8192
EPS = 1 / 8
GROUPS = 16
#: Sequences' tokens that are planned together when the order is kept.
STRETCH = 2048


def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """lengths: (length, count), falling.  Groups of equal cardinality (the last may be smaller), each a list of (length, count)."""
    total = sum(n for _, n in lengths)
    size = -(-total // groups)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
    return out


def best_configuration(sizes: list[int], values: list[float], capacity: int, most: list[int]) -> tuple[float, list[int]]:
    """The configuration of largest value; exact branch and bound over sizes by value per length."""
    order = sorted((i for i in range(len(sizes)) if values[i] > 1e-12), key=lambda i: -values[i] / sizes[i])
    best: list = [0.0, [0] * len(sizes)]
    now = [0] * len(sizes)

    def go(k: int, room: int, value: float) -> None:
        if value > best[0] + 1e-12:
            best[0], best[1] = value, now.copy()
        if k == len(order):
            return
        i = order[k]
        if value + room * values[i] / sizes[i] <= best[0] + 1e-12:
            return
        for c in range(min(room // sizes[i], most[i]), -1, -1):
            now[i] = c
            go(k + 1, room - c * sizes[i], value + c * values[i])
        now[i] = 0

    go(0, capacity, 0.0)
    return best[0], best[1]


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(configuration, times) that cover at most the demand: the linear program's solution rounded down."""
    m = len(sizes)
    most = [capacity // s for s in sizes]
    columns = [[(most[i] if j == i else 0) for j in range(m)] for i in range(m)]
    basis = np.array(columns, dtype=float).T
    x = np.array([d / k for d, k in zip(demand, most, strict=True)])
    for _ in range(200 * m):
        inverse = np.linalg.inv(basis)
        prices = inverse.T @ np.ones(m)
        value, column = best_configuration(sizes, prices.tolist(), capacity, most)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ np.array(column, dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = x - step * direction
        x[leave] = step
        x = np.maximum(x, 0)
        basis[:, leave] = column
        columns[leave] = column
    out = [(columns[i], int(np.floor(x[i] + 1e-6))) for i in range(m)]
    # rounding must not take more than there is
    left = list(demand)
    good = []
    for c, n in out:
        n = min([n, *(left[j] // c[j] for j in range(m) if c[j])])
        if n > 0:
            left = [a - n * b for a, b in zip(left, c, strict=True)]
            good.append((c, n))
    # the rest, at most about one sequence for each configuration of the basis: largest first
    while any(left):
        c, room = [0] * m, capacity
        for j in range(m):
            c[j] = min(left[j], room // sizes[j])
            room -= c[j] * sizes[j]
        n = min(left[j] // c[j] for j in range(m) if c[j])
        left = [a - n * b for a, b in zip(left, c, strict=True)]
        good.append((c, n))
    return good


def plan(histogram: dict[int, int], capacity: int = CAPACITY, eps: float = EPS, groups: int = GROUPS) -> np.ndarray:
    """Runs (length, first rank, number, first sequence, pieces a sequence, offset of the first piece in each), sorted by length and rank.

    A run's piece of rank first + i is in sequence ``first sequence + i // per`` at
    ``offset + (i % per) * length``.
    """
    import bisect

    runs: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = {}
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, number)
    sequences = 0

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        if n:
            runs.append((length, rank.get(length, 0), n, first, per, offset))
            rank[length] = rank.get(length, 0) + n

    full = histogram.get(capacity, 0)
    place(capacity, full, 0, 1, 0)
    sequences += full
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if eps * capacity < s < capacity]
    if large:
        grouped = linear_groups(large, groups)
        sizes = [g[0][0] for g in grouped]
        merged: dict[int, list[tuple[int, int]]] = {}  # groups of equal rounded size are one
        for s, g in zip(sizes, grouped, strict=True):
            merged.setdefault(s, []).extend(g)
        sizes = sorted(merged, reverse=True)
        supply = [list(reversed(merged[s])) for s in sizes]  # taken from the end: falling length
        demand = [sum(n for _, n in g) for g in supply]
        for config, times in configurations(sizes, demand, capacity):
            # substitute: each place of the configuration takes the next pieces of its group, in all its sequences
            places: list[list[tuple[int, int]]] = []
            for j, c in enumerate(config):
                for _ in range(c):
                    need, got = times, []
                    while need:
                        length, n = supply[j].pop()
                        take = min(n, need)
                        got.append((length, take))
                        need -= take
                        if n > take:
                            supply[j].append((length, n - take))
                    places.append(got)
            cursor = [0] * len(places)
            used = [0] * len(places)
            at = 0
            while at < times:  # stretches of sequences whose pieces have the same lengths
                step = min(p[cursor[i]][1] - used[i] for i, p in enumerate(places))
                offset = 0
                for i, p in enumerate(places):
                    length = p[cursor[i]][0]
                    place(length, step, sequences + at, 1, offset)
                    offset += length
                    used[i] += step
                    if used[i] == p[cursor[i]][1]:
                        cursor[i], used[i] = cursor[i] + 1, 0
                rooms.setdefault(capacity - offset, []).append((sequences + at, step))
                at += step
            sequences += times
    # best fit of the small ones
    keys = sorted(rooms)
    for s in (s for s in sorted(histogram, reverse=True) if s <= eps * capacity):
        n = histogram[s]
        while n:
            i = bisect.bisect_left(keys, s)
            if i < len(keys):
                room = keys[i]
            else:
                room = capacity
                per = capacity // s
                rooms.setdefault(capacity, []).append((sequences, -(-n // per)))
                sequences += -(-n // per)
                bisect.insort(keys, capacity)
            first, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.remove(room)
            per = room // s
            whole = min(count, n // per)
            rest = n - whole * per if whole < count else 0
            rest = min(rest, per - 1) if whole < count else 0
            place(s, whole * per, first, per, capacity - room)
            place(s, rest, first + whole, max(rest, 1), capacity - room)
            n -= whole * per + rest
            for left, a, b in ((room - per * s, first, whole), (room - rest * s, first + whole, 1 if rest else 0), (room, first + whole + (rest > 0), count - whole - (rest > 0))):
                if b > 0 and left > 0:
                    if left not in rooms:
                        bisect.insort(keys, left)
                    rooms.setdefault(left, []).append((a, b))
    out = np.array(runs, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length): the full sequences of each document and its rest."""
    tokens = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sized = docs.select(F.col("doc_id").cast("long"), tokens.alias("tokens"))
    cut = F.explode(F.sequence(F.lit(0), F.expr(f"cast((tokens - 1) div {capacity} as int)")))
    return sized.select("doc_id", cut.alias("piece"), "tokens").select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece").cast("long") * capacity).cast("int").alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, eps: float = EPS, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, sequence, seq_offset) for every piece: tokens [start, start + length) of the document lie at seq_offset of the sequence."""
    spark = docs.sparkSession
    ordered = pieces(docs, capacity).repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    kept = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("at", 33).alias("part")
    # rank = pieces of the length in earlier partitions + place among those of its partition
    counts = materialize(kept.groupBy("length", part).agg(F.count("*").alias("n"), F.min("at").alias("first")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, capacity, eps, groups))  # its size depends on the capacity only
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("length").alias("o_length"), F.col("part").alias("o_part"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    ranked = kept.join(offsets, (F.col("length") == F.col("o_length")) & (F.shiftright("at", 33) == F.col("o_part"))).select("doc_id", "piece", "length", (F.col("at") + F.col("shift")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        wide = int(r[:, 1].max(initial=0)) + 1 if len(r) else 1
        keys = r[:, 0] * wide + r[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            k = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), "right") - 1
            i = rank - r[k, 1]
            piece = b.column(1).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(piece * capacity), b.column(2), pa.array(r[k, 3] + i // r[k, 4]), pa.array((r[k, 5] + i % r[k, 4] * length).astype(np.int32))],
                names=["doc_id", "piece", "start", "length", "sequence", "seq_offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length int, sequence long, seq_offset int")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, begin): the token at which each row begins; the order is that of the rows in the files of docs."""
    tokens = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("tokens")

    def rows(df: DataFrame, *columns) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).cast("int").alias("part"), at["file_name"].alias("file"), at["row_index"].alias("row"))

    try:
        slim = rows(docs, tokens)
        slim.schema  # noqa: B018
    except AnalysisException:  # not a table of files
        slim = rows(materialize(docs.select("doc_id", tokens), "ordered"), "tokens")
    files = slim.groupBy("part", "file").agg(F.sum("tokens").alias("n"))  # as many rows as files
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file").alias("o_file"), before.alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = slim.withColumn("within", within)
    return placed.join(files, F.col("file") == F.col("o_file")).select("doc_id", "tokens", (F.col("before") + F.col("within")).alias("begin"))


def pack_stretch(doc: np.ndarray, known: np.ndarray, piece: np.ndarray, length: np.ndarray, position: np.ndarray, capacity: int, eps: float, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; pieces are sorted by length and position; known: doc isn't null."""
    r = plan(dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True)), capacity, eps, groups)
    rank = np.arange(len(length)) - np.searchsorted(length, length)
    wide = int(r[:, 1].max()) + int(rank.max()) + 1
    k = np.searchsorted(r[:, 0] * wide + r[:, 1], length * wide + rank, "right") - 1
    i = rank - r[k, 1]
    sequence, offset = r[k, 3] + i // r[k, 4], r[k, 5] + i % r[k, 4] * length
    # copies of a piece don't share a sequence
    by = np.lexsort((position, piece, doc, sequence))
    a, b = by[:-1], by[1:]
    again = b[(sequence[a] == sequence[b]) & (doc[a] == doc[b]) & (piece[a] == piece[b]) & known[a] & known[b]]
    if len(again):
        fill = np.bincount(sequence, length).astype(np.int64)
        moved = set(zip(doc[again].tolist(), piece[again].tolist(), strict=True))
        held: dict[tuple[int, int], set[int]] = {}
        for key, at, ok in zip(zip(doc.tolist(), piece.tolist(), strict=True), sequence.tolist(), known.tolist(), strict=True):
            if ok and key in moved:
                held.setdefault(key, set()).add(at)
        for j in again.tolist():
            own = held[int(doc[j]), int(piece[j])]
            fill[sequence[j]] -= length[j]
            room = fill + length[j] <= capacity
            room[list(own)] = False
            fits = np.flatnonzero(room)
            if not len(fits):
                fits, fill = np.array([len(fill)]), np.append(fill, 0)
            to = int(fits[fill[fits].argmax()])
            fill[to] += length[j]
            sequence[j], offset[j] = to, capacity  # last there
            own.add(to)
    mean = np.bincount(sequence, position) / np.bincount(sequence)
    number = np.empty(len(mean), np.int64)
    number[np.argsort(mean, kind="stable")] = np.arange(len(mean))
    sequence = number[sequence]
    by = np.lexsort((position, offset, sequence))
    ends = np.cumsum(length[by])
    first = np.flatnonzero(np.diff(sequence[by], prepend=-1))
    base = np.repeat((ends - length[by])[first], np.diff(np.append(first, len(by))))
    offset[by] = ends - length[by] - base
    return sequence, offset


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, eps: float = EPS, groups: int = GROUPS, stretch: int | None = None) -> DataFrame:
    """As pack, with sequences in the order of the rows of docs, stretch by stretch; ``position``, the piece's first token in that order, tells copies apart."""
    size = (stretch or STRETCH) * capacity
    rows = in_order(docs).select("doc_id", "tokens", "begin", F.explode(F.sequence(F.lit(0), F.expr(f"cast((tokens - 1) div {capacity} as int)"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    cut = rows.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("length"), (F.col("begin") + start).alias("position"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "ascending"), ("position", "ascending")])
        doc = t.column("doc_id").combine_chunks()
        piece, length, position = (t.column(c).to_numpy().astype(np.int64) for c in ("piece", "length", "position"))
        known = np.asarray(doc.is_valid().to_numpy(zero_copy_only=False))
        sequence, offset = pack_stretch(doc.fill_null(0).to_numpy(), known, piece, length, position, capacity, eps, groups)
        return pa.table({"doc_id": doc, "piece": t.column("piece"), "start": piece * capacity, "length": t.column("length"), "position": position, "stretch": t.column("stretch"), "sequence": sequence, "seq_offset": offset.astype(np.int32)})

    by = cut.withColumn("stretch", F.expr(f"position div {size}")).groupBy("stretch")
    local = materialize(by.applyInArrow(run, "doc_id long, piece int, start long, length int, position long, stretch long, sequence long, seq_offset int"), "stretches")
    counts = local.groupBy("stretch").agg((F.max("sequence") + 1).alias("n"))  # a row a stretch
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("stretch").alias("o_stretch"), before.alias("before"))
    return local.join(counts, F.col("stretch") == F.col("o_stretch")).select("doc_id", "piece", "start", "length", "position", (F.col("sequence") + F.col("before")).alias("sequence"), "seq_offset")


def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
