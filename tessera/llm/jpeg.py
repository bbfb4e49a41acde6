"""Media columns: dimensions, DC-only thumbnails and hashes of baseline JPEG images.

The markers are parsed, the scans' Huffman codes are decoded (coefficients other than DC only
to be skipped: one look at the next 16 bits skips all that are whole there), and the DC values of the first component give a luminance thumbnail of one
pixel for each of its 8 x 8 blocks.  Where an Adobe marker says that the components are RGB, CMYK or YCCK, the luminance is computed from the DC values of all.  No picture is ever reconstructed in full.  The hash
has a bit for each of 8 x 8 horizontal neighbours in a 9 x 8 sample of the thumbnail
that gets brighter to the right.

``decode_media`` works on any binary column.  The corpus has no pictures, so the query makes a media column
from ``embeddings``: each vector is drawn, with all its entries, as a square field of grey levels, enlarged and
textured, in sizes and colour layouts that depend on the vector, and encoded by ``encode`` (baseline,
standard tables, with and without chroma subsampling and restart markers).

Defined results (``status``): ``ok``; ``null``; ``not_jpeg`` (no start marker; empty included);
``unsupported`` (progressive, arithmetic, lossless, 12 bits); ``corrupt`` (a broken or
truncated stream; a whole scan without an end marker is ok).  Pictures of any size are decoded whole.  Ties don't arise.  Dimensions are given as soon as the frame header was read; thumbnail and
hash only with ``ok``.  Rows are decoded one by one, repeated ones too; every row is in the
result.  Extra columns are kept unless they have the name of a result, which then wins.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, own_name, table

RESULT = "status string, width int, height int, components int, thumb_width int, thumb_height int, thumb binary, thumb_hash long"
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


class Unsupported(ValueError):
    pass


@lru_cache(maxsize=64)
def lookup(spec: bytes) -> list[int]:
    """For the next 16 bits: code length << 8 | symbol, or -1; spec: 16 counts and the symbols."""
    table = [-1] * 65536
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low = code << (16 - length)
            if low >= 65536:
                raise ValueError("code table")
            table[low : low + (1 << (16 - length))] = [length << 8 | spec[k]] * (1 << (16 - length))
            code += 1
            k += 1
        code <<= 1
    return table


@lru_cache(maxsize=64)
def skips(spec: bytes) -> tuple[list[int], list[int]]:
    """For the next 16 bits: (all AC codes that are whole there, the first one), as bits << 8 | end of block << 7 | coefficients, or -1."""
    one = np.array(lookup(spec))
    symbol = one & 255
    size = symbol & 15
    end = (size == 0) & (symbol != 0xF0)
    bits = np.where(one < 0, 0, (one >> 8) + size)
    step = np.where(end, 0, np.where(size == 0, 16, (symbol >> 4) + 1))
    first = np.where(one < 0, -1, bits << 8 | end << 7 | step)
    at, all_bits, all_steps, ended = np.arange(65536), bits.copy(), step.copy(), end.copy()
    more = (one >= 0) & ~end & (bits < 16)
    while more.any():
        i = np.flatnonzero(more)
        j = (at[i] << all_bits[i]) & 65535
        fits = (one[j] >= 0) & (all_bits[i] + bits[j] <= 16) & (all_steps[i] + step[j] <= 63)
        more[i[~fits]] = False
        i, j = i[fits], j[fits]
        all_bits[i] += bits[j]
        all_steps[i] += step[j]
        ended[i] = end[j]
        more[i] = ~end[j] & (all_bits[i] < 16)
    return np.where(one < 0, -1, all_bits << 8 | ended << 7 | all_steps).tolist(), first.tolist()


def _segment(data: bytes, plan: list[tuple[int, list[int], tuple[list[int], list[int]]]], units: int, out: list[list[int]]) -> None:
    """Decode a run without restart markers: ``units`` times the blocks of ``plan`` (component, DC table, AC tables); DC values are appended to out."""
    data = data.replace(b"\xff\x00", b"\xff")
    size = len(data) * 8
    data += b"\xff" * 16
    at, acc, have = 0, 0, 0  # next byte, bit buffer, its bits
    pred = [0] * len(out)
    for _ in range(units):
        for comp, dc, (ac, ac_one) in plan:
            if have < 32:
                acc = ((acc & ((1 << have) - 1)) << 48) | int.from_bytes(data[at : at + 6])
                at += 6
                have += 48
            hit = dc[(acc >> (have - 16)) & 65535]
            s = hit & 255
            if hit < 0 or s > 11:
                raise ValueError("DC code")
            have -= hit >> 8
            if s:
                have -= s
                v = (acc >> have) & ((1 << s) - 1)
                pred[comp] += v if v >> (s - 1) else v - (1 << s) + 1
            out[comp].append(pred[comp])
            k = 1
            while k < 64:
                if have < 32:
                    acc = ((acc & ((1 << have) - 1)) << 48) | int.from_bytes(data[at : at + 6])
                    at += 6
                    have += 48
                hit = ac[(acc >> (have - 16)) & 65535]
                to = k + (hit & 127)
                if to >= 64 and hit >= 0:  # the last codes may be of the next block
                    hit = ac_one[(acc >> (have - 16)) & 65535]
                    to = k + (hit & 127)
                if hit < 0:
                    raise ValueError("AC code")
                have -= hit >> 8
                if hit & 128:
                    break
                k = to
            if k > 64:
                raise ValueError("run of coefficients")
            if at * 8 - have > size:
                raise ValueError("end of scan data")


def decode(data: bytes | None) -> tuple:
    """A tuple of RESULT."""
    blank = [None] * 7
    if data is None:
        return ("null", *blank)
    data = bytes(data)
    if data[:2] != b"\xff\xd8":
        return ("not_jpeg", *blank)
    head: list = [None, None, None]
    try:
        thumb = _thumbnail(data, head)
    except Unsupported:
        return ("unsupported", *head, *[None] * 4)
    except (ValueError, IndexError, KeyError, struct.error):
        return ("corrupt", *head, *[None] * 4)
    return ("ok", *head, thumb.shape[1], thumb.shape[0], thumb.tobytes(), thumb_hash(thumb))


def _thumbnail(data: bytes, head: list) -> np.ndarray:
    quant: dict[int, int] = {}
    tables: dict[tuple[int, int], list[int] | tuple[list[int], list[int]]] = {}
    adobe: int | None = None
    frame: list[tuple[int, int, int, int]] = []  # id, h, v, quantization table
    restart, at, width, height = 0, 2, 0, 0
    dcs: dict[int, tuple[list[int], int]] = {}  # component -> values, blocks a row
    while True:
        if at >= len(data) and 0 in dcs:
            break  # no end marker
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        at += 1
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2])
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("segment")
        at += size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + (1 if wide else 0)])
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                if len(body) < k + 17 + n:
                    raise ValueError("code table")
                spec = bytes(body[k + 1 : k + 17 + n])
                tables[body[k] >> 4, body[k] & 15] = skips(spec) if body[k] >> 4 else lookup(spec)
                k += 17 + n
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            head[:] = [width, height, n]
            if marker != 0xC0 or depth != 8:
                raise Unsupported
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not (width and height and n) or any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in frame):
                raise ValueError("frame")
        elif marker in (0xCC, 0xC8):
            raise Unsupported
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2])
        elif marker == 0xDA:
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            numbers = {c: i for i, (c, *_) in enumerate(frame)}
            chosen = [(numbers[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            hmax, vmax = max(h for _, h, _, _ in frame), max(v for _, _, v, _ in frame)
            if len(chosen) == 1:
                i, t = chosen[0]
                across, down = -(-(-(-width * frame[i][1] // hmax)) // 8), -(-(-(-height * frame[i][2] // vmax)) // 8)
                plan = [(i, tables[0, t >> 4], tables[1, t & 15])]
                units, shape = across * down, {i: (across, 1, 1)}
            else:
                across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
                plan = [(i, tables[0, t >> 4], tables[1, t & 15]) for i, t in chosen for _ in range(frame[i][1] * frame[i][2])]
                units, shape = across * down, {i: (across, frame[i][1], frame[i][2]) for i, _ in chosen}
            out: list[list[int]] = [[] for _ in frame]
            scan, left = data[at:end], units
            pieces = [scan]
            if restart:
                pieces, begin, look = [], 0, 0
                while True:
                    look = scan.find(b"\xff", look)
                    if look < 0:
                        break
                    if 0xD0 <= scan[look + 1] <= 0xD7:
                        pieces.append(scan[begin:look])
                        begin = look + 2
                    look += 2
                pieces.append(scan[begin:])
            for piece in pieces:
                n = min(left, restart) if restart else left
                _segment(piece, plan, n, out)
                left -= n
            if left:
                raise ValueError("restart intervals")
            for i, s in shape.items():
                dcs[i] = (out[i], s)
            at = end
    hmax, vmax = max(f[1] for f in frame), max(f[2] for f in frame)

    def plane(i: int) -> np.ndarray:
        values, (across, h, v) = dcs[i]
        grid = np.array(values, dtype=np.int64).reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
        grid = grid[: -(-(-(-height * frame[i][2] // vmax)) // 8), : -(-(-(-width * frame[i][1] // hmax)) // 8)]
        return np.clip(np.floor(grid * quant[frame[i][3]] / 8 + 128.5), 0, 255)

    y = plane(0)

    def like_first(i: int) -> np.ndarray:
        p = plane(i)
        return p[np.arange(y.shape[0]) * p.shape[0] // y.shape[0]][:, np.arange(y.shape[1]) * p.shape[1] // y.shape[1]]

    if len(frame) == 3 and (adobe == 0 or (adobe is None and bytes(f[0] for f in frame) == b"RGB")) or len(frame) == 4 and not adobe:
        y = 0.299 * y + 0.587 * like_first(1) + 0.114 * like_first(2)
    if len(frame) == 4:  # inks are stored as what they leave
        y = y * like_first(3) / 255
    return np.floor(y + 0.5).astype(np.uint8)


def thumb_hash(thumb: np.ndarray) -> int:
    rows = (2 * np.arange(8) + 1) * thumb.shape[0] // 16
    cols = (2 * np.arange(9) + 1) * thumb.shape[1] // 18
    s = thumb[rows][:, cols].astype(int)
    return int(np.packbits(s[:, 1:] > s[:, :-1]).view(">i8")[0])


def decode_media(media: DataFrame, column: str) -> DataFrame:
    """``media`` without the binary column, with the columns of RESULT."""

    @F.pandas_udf(RESULT)
    def run(images: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(x) for x in images], columns=[c.split()[0] for c in RESULT.split(", ")]).astype(
            {c: "Int64" for c in ("width", "height", "components", "thumb_width", "thumb_height", "thumb_hash")}
        )

    names = {c.split()[0] for c in RESULT.split(", ")}
    keep = [named(c) for c in media.columns if c != column and c.lower() not in names]
    own = own_name(media, "jpeg")
    return media.select(*keep, run(named(column)).alias(own)).select(*keep, f"{own}.*")


# ---- a baseline encoder, for media columns and tests

_DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])
#: An AC code of one's own: all 162 symbols, the frequent ones shortest.
_AC_SYMBOLS = sorted([0x00, 0xF0, *((r << 4) | s for r in range(16) for s in range(1, 11))], key=lambda x: ((x >> 4) + 2 * (x & 15) if x not in (0, 0xF0) else (0 if x == 0 else 14), x))
_AC = bytes([0, 1, 1, 2, 3, 5, 7, 11, 13, 15, 12, 12, 20, 20, 20, 20]) + bytes(_AC_SYMBOLS)
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _codes(spec: bytes) -> dict[int, tuple[int, int]]:
    code, k, out = 0, 16, {}
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[spec[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode(planes: list[np.ndarray], factors: list[tuple[int, int]] | None = None, q: int = 16, restart: int = 0) -> bytes:
    """Baseline JPEG of uint8 planes; plane i has factors[i] (h, v) samples a unit, the first one the picture's size."""
    factors = factors or [(1, 1)] * len(planes)
    height, width = planes[0].shape
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = (-(-width // (8 * hmax)), -(-height // (8 * vmax))) if len(planes) > 1 else (-(-width // 8), -(-height // 8))
    if len(planes) == 1:
        factors = [(1, 1)]
    blocks = []
    for p, (h, v) in zip(planes, factors, strict=True):
        full = np.pad(p, ((0, down * v * 8 - p.shape[0]), (0, across * h * 8 - p.shape[1])), mode="edge").astype(float) - 128
        tiles = full.reshape(down * v, 8, across * h, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(_COS @ tiles @ _COS.T / q).astype(int).reshape(down * v, across * h, 64)[:, :, ZIGZAG])
    dc, ac = _codes(_DC), _codes(_AC)
    out, bits, n, pred, done, mark = bytearray(), 0, 0, [0] * len(planes), 0, 0

    def flush() -> bytes:
        pad = -n % 8
        return (((bits << pad) | ((1 << pad) - 1)).to_bytes((n + pad) // 8, "big")).replace(b"\xff", b"\xff\x00")

    for y in range(down):
        for x in range(across):
            for i, (h, v) in enumerate(factors):
                for b in range(h * v):
                    z = blocks[i][y * v + b // h, x * h + b % h]
                    diff, pred[i] = int(z[0]) - pred[i], int(z[0])
                    items, run = [(diff, dc, 0)], 0
                    for k in np.flatnonzero(z[1:]).tolist() if z[1:].any() else []:
                        gap = k - run
                        while gap > 15:
                            items.append((0, ac, 0xF0))
                            gap -= 16
                        items.append((int(z[k + 1]), ac, gap << 4))
                        run = k + 1
                    if run < 63:
                        items.append((0, ac, 0))
                    for value, codes, high in items:
                        s = abs(value).bit_length()
                        code, length = codes[high | s]
                        bits, n = ((bits << length) | code), n + length
                        if s:
                            bits, n = (bits << s) | (value if value > 0 else value + (1 << s) - 1), n + s
            done += 1
            if restart and done % restart == 0 and done < across * down:
                out += flush() + bytes([0xFF, 0xD0 + mark % 8])
                bits, n, pred, mark = 0, 0, [0] * len(planes), mark + 1
    out += flush()
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    scan = bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0])
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0]) + bytes([q]) * 64) + seg(0xC0, frame) + seg(0xC4, bytes([0]) + _DC + bytes([0x10]) + _AC) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, scan) + bytes(out) + b"\xff\xd9"


def draw(vec_id: int, vector: np.ndarray) -> bytes:
    """The picture of a vector."""
    side = max(8, math.isqrt(max(len(vector) - 1, 0)) + 1)
    field = np.zeros(side * side)
    field[: len(vector)] = np.nan_to_num(np.asarray(vector, float))
    spread = max(float(np.abs(field).max()), 1e-9)
    grey = np.clip(128 + 100 * field / spread, 0, 255).reshape(side, side)
    height, width = 5 * side + vec_id % 5 * 4, 5 * side + vec_id % 7 * 3
    big = grey[(np.arange(height) * side // height)][:, np.arange(width) * side // width] + (np.arange(width) % 4)[None] * 3.0
    luma = np.clip(big, 0, 255).astype(np.uint8)
    if vec_id % 3 == 0:
        return encode([luma], restart=(3 if vec_id % 2 else 0))
    half = luma[::2, ::2]
    if vec_id % 3 == 1:
        return encode([luma, half, 255 - half], [(2, 2), (1, 1), (1, 1)])
    return encode([luma, luma, 255 - luma])


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, image): null for a null vector."""

    @F.pandas_udf("binary")
    def paint(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else draw(0 if i != i or i is None else int(i), v) for i, v in zip(ids, vectors, strict=True)], dtype=object)

    return embeddings.select("vec_id", paint(F.col("vec_id"), F.col("embedding")).alias("image"))


def op9_media_jpeg(spark, sf_dir):
    return decode_media(pictures(table(spark, sf_dir, "embeddings")), "image")
