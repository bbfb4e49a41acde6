"""Token ids as length-delimited binary records with a separate offset index.

A record is the length of its payload (eight bytes), the masked CRC-32C of those eight
bytes, the payload, and the payload's masked CRC-32C: the TFRecord framing.  A payload is one serialized
sequence: a flag byte (1: no doc_id, 2: no text, 4: four bytes an id), the doc_id (eight bytes) and the token
ids, little-endian, two bytes each (four if the vocabulary has more than 65,536, as the flag tells the reader).

Each task writes one file whose name holds the number of its attempt, and returns its part of the
index; the index is a Parquet table of its own.  A task that runs again writes another
file, and the index names the one that counts, so lost executors and
speculation do no harm; files that the index doesn't name are removed at the end.  Data files are written where executors write, by Arrow's
file systems: folders of file:, hdfs: (libhdfs), s3: or s3a:, gs: and abfs: or abfss: are supported, others are an error at once.
The vocabulary is read by the driver and broadcast: its size doesn't depend on the data.  ``read_records`` reads records in any order by offset
and length, checks both checksums, and gives the token ids back.

Checksums are computed for all records of a batch together: CRC-32C is linear over
XOR, so a block's checksum is the XOR of a table entry for each byte and place.

Defined results.  A null or empty text is a record without tokens; null texts and null doc_ids
come back as such.  Texts of any length are one record.  doc_id must be an integer.  Ties don't arise.  Repeated rows are records of their own.  Special tokens' strings in a text are
ordinary text.  Extra columns are ignored.  An empty table gives an empty index.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of byte-level vocabularies into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
HEAD = 9
BLOCK = 256
POLY = 0x82F63B78
INDEX = "doc_id long, file string, record long, offset long, length long, n_tokens long, crc long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(place, byte): the share of a byte with so many bytes of a block after it; (4, byte): the state after a whole block of zeros."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLY), first >> 1).astype(np.uint32)
    step = lambda s: (s >> np.uint32(8)) ^ first[s & np.uint32(255)]
    after = [first]
    for _ in range(BLOCK - 1):
        after.append(step(after[-1]))
    shift = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    for _ in range(BLOCK):
        shift = step(shift)
    return np.stack(after[::-1]), shift


class Crc32c:
    def __init__(self):
        self.place, self.shift = _tables()

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32C of each data[start : start + length]; lengths of four at least."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.uint32)
        blocks = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)  # zeros in front change nothing
        to = first[1:] * BLOCK - lengths
        where = np.repeat(to - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        source = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        padded[where] = data[source]
        for j in range(4):  # the register starts with ones
            padded[to + j] ^= 255
        grid = padded.reshape(-1, BLOCK)
        each = np.empty(len(grid), np.uint32)
        base = np.arange(BLOCK, dtype=np.int32) * 256
        flat = self.place.ravel()
        for at in range(0, len(grid), 2048):
            each[at : at + 2048] = np.bitwise_xor.reduce(flat[grid[at : at + 2048] + base], axis=1)
        out = np.zeros(n, np.uint32)
        order = np.argsort(-blocks, kind="stable")
        for k in range(int(blocks.max())):
            live = order[: np.searchsorted(-blocks[order], -k, side="left")]
            s = out[live]
            moved = self.shift[0][s & 255] ^ self.shift[1][(s >> 8) & 255] ^ self.shift[2][(s >> 16) & 255] ^ self.shift[3][s >> 24]
            out[live] = moved ^ each[first[live] + k]
        return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Hadoop's schemes -> Arrow's.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def file_system(folder: str):
    """(Arrow's file system, path in it) of a folder as Hadoop names it."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", f"//{folder}"
    if scheme not in SCHEMES:
        raise ValueError(f"no records can be written to {scheme}: folders")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def frame(ids: list, doc_ids: np.ndarray, flags: np.ndarray, dtype, crc: Crc32c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, lengths of the payloads, checksums of the payloads)."""
    width = np.dtype(dtype).itemsize
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    lengths = HEAD + counts * width
    sizes = lengths + 16
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    put = lambda at, values: out.__setitem__(at[:, None] + np.arange(values.dtype.itemsize), np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1))
    put(offsets, lengths.astype("<u8"))
    out[offsets + 12] = flags
    put(offsets + 13, doc_ids.astype("<i8"))
    body = np.concatenate([np.asarray(x, dtype=dtype) for x in ids]).view(np.uint8) if counts.sum() else np.zeros(0, np.uint8)
    before = np.concatenate([[0], np.cumsum(counts * width)[:-1]])
    out[np.repeat(offsets + 12 + HEAD - before, counts * width) + np.arange(len(body))] = body
    put(offsets + 8, masked(crc(out, offsets, np.full(len(ids), 8))).astype("<u4"))
    sums = masked(crc(out, offsets + 12, lengths))
    put(offsets + 12 + lengths, sums.astype("<u4"))
    return out, offsets, lengths, sums


def write_records(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the records to ``path``/data and their index to ``path``/index; returns the index, read back."""
    spark = docs.sparkSession
    folder = f"{path}/data"
    disk, base = file_system(folder)
    disk.create_dir(base, recursive=True)
    ranks = spark.sparkContext.broadcast(vocabulary_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        coder, crc = encoder(ranks.value), Crc32c()
        dtype = np.dtype("<u2" if coder.max_token_value < 1 << 16 else "<u4")
        disk, base = file_system(folder)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.rec"
        at, record, sink = 0, 0, None
        try:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    c = b.slice(lo, 256)
                    texts = c.column(1).to_pylist()
                    ids = [coder.encode_ordinary(t) if t else [] for t in texts]
                    flags = np.array(c.column(0).is_null(), dtype=np.uint8) + 2 * np.array(c.column(1).is_null(), dtype=np.uint8) + np.uint8(4 * (dtype.itemsize == 4))
                    data, offsets, lengths, sums = frame(ids, c.column(0).fill_null(0).to_numpy(), flags, dtype, crc)
                    sink = sink or disk.open_output_stream(f"{base}/{name}")
                    sink.write(data.tobytes())
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [c.column(0), pa.array([name] * n), pa.array(np.arange(record, record + n)), pa.array(offsets + at), pa.array(lengths), pa.array(np.array([len(x) for x in ids], dtype=np.int64)), pa.array(sums.astype(np.int64))],
                        names=["doc_id", "file", "record", "offset", "length", "n_tokens", "crc"],
                    )
                    at += len(data)
                    record += n
        finally:
            if sink:
                sink.close()

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    named = {r["file"] for r in index.select("file").distinct().toLocalIterator()}  # as many as tasks
    for f in disk.get_file_info(_selector(base)):
        if f.base_name not in named:  # of an attempt that failed or wasn't needed
            disk.delete_file(f.path)
    return index


def _selector(base: str):
    from pyarrow import fs

    return fs.FileSelector(base)


def read_records(index: DataFrame, path: str, seed: int | None = None) -> DataFrame:
    """(doc_id, tokens, has_text) of the records of ``index``; shuffled if there is a seed."""
    folder = f"{path}/data"
    if seed is not None:
        index = index.orderBy(F.xxhash64(F.lit(seed), "file", "record"), "file", "record")
    crc = Crc32c()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = file_system(folder)
        opened: dict = {}
        for b in batches:
            ids, tokens, has = [], [], []
            for name, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if name not in opened:
                    opened[name] = disk.open_input_file(f"{base}/{name}")
                raw = np.frombuffer(opened[name].read_at(length + 16, offset), np.uint8)
                told = lambda at, kind: int(raw[at : at + np.dtype(kind).itemsize].view(kind)[0])  # noqa: E731, B023
                sums = masked(crc(raw, np.array([0, 12]), np.array([8, length])))
                if len(raw) != length + 16 or told(0, "<u8") != length or told(8, "<u4") != sums[0] or told(12 + length, "<u4") != sums[1]:
                    raise ValueError(f"damaged record at {offset} of {name}")
                flag = int(raw[12])
                ids.append(None if flag & 1 else told(13, "<i8"))
                has.append(not flag & 2)
                tokens.append(raw[12 + HEAD : 12 + length].view("<u4" if flag & 4 else "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(has, pa.bool_())], names=["doc_id", "tokens", "has_text"])

    return index.select("file", "offset", "length").mapInArrow(run, "doc_id long, tokens array<int>, has_text boolean")


def op8_binary_records(spark, sf_dir):
    """Writes the records of all documents to the shared folder; the result is their index."""
    return write_records(table(spark, sf_dir, "documents"), fresh_path(spark, "records"))
