"""Baseline JPEG as a column: bytes stored as coefficients, scans decoded in numpy, thumbnails of DC terms.

A payload of 64-byte units becomes a grey baseline JPEG with one 8x8 block for each unit: the 64 bytes
are the block's quantized coefficients in zigzag order, with a quantization table of ones, so storage
is lossless. The most frequent bytes take the smallest coefficients, and the Huffman tables are made
for running text. Each block is a restart interval, so blocks decode on their own.

The decoder reads any baseline (SOF0) scan: markers, quantization and Huffman tables, sampling
factors, restart intervals. All restart intervals, of all images at hand, are decoded in step: one
Huffman symbol of each at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

UNIT = 64
#: Blocks that are encoded or decoded side by side.
LANES = 1 << 14
#: Bytes of texts or images that are taken together.
TOGETHER = 1 << 22


def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in scan order: diagonals, each the other way."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 == 0 else c[0]))
    return np.array([y * 8 + x for y, x in cells])


def byte_order() -> np.ndarray:
    """Rank of each byte: letters of running text by frequency, then the other printable bytes, then the rest."""
    first = b" enatriosduhlcmgpfbvwyq.,\xc3kxjz\n"
    rest = [b for b in [*range(32, 127), *range(128, 256), *range(32), 127] if b not in first]
    rank = np.empty(256, np.int32)
    rank[np.array([*first, *rest])] = np.arange(256)
    return rank


_RANK = byte_order()
#: Rank 0, 1, 2, 3, 4 ... to coefficient 0, 1, -1, 2, -2 ...
_TO_COEFFICIENT = ((_RANK + 1) // 2 * np.where(_RANK % 2, 1, -1)).astype(np.int32)
_FROM_COEFFICIENT = np.zeros(257, np.uint8)
_FROM_COEFFICIENT[_TO_COEFFICIENT + 128] = np.arange(256)
_SIZE = np.zeros(4096, np.int64)
for _i in range(1, 4096):
    _SIZE[_i] = _SIZE[_i >> 1] + 1


def huffman_lengths(counts: np.ndarray, longest: int = 16) -> np.ndarray:
    """Code lengths for symbols with counts, none over ``longest`` and none all ones (one place is kept free, as JPEG asks)."""
    import heapq

    used = np.flatnonzero(counts)
    heap = [(int(counts[s]), i, [int(s)]) for i, s in enumerate(used)] + [(0, -1, [-1])]
    lengths = dict.fromkeys([-1, *map(int, used)], 0)
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    bits = np.bincount(list(lengths.values()), minlength=64)
    for i in range(len(bits) - 1, longest, -1):  # longer codes are paired up under a shorter one
        while bits[i] > 0:
            j = i - 2
            while bits[j] == 0:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    # The free place has the longest code, which goes.
    bits[np.flatnonzero(bits)[-1]] -= 1
    out = np.zeros(len(counts), np.int64)
    order = sorted(map(int, used), key=lambda s: (lengths[s], s))
    out[order] = np.repeat(np.arange(len(bits)), bits)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Codes by symbol, and the BITS and HUFFVAL lists of a DHT segment."""
    codes, code, values, bits = np.zeros(len(lengths), np.int64), 0, [], []
    for n in range(1, 17):
        own = np.flatnonzero(lengths == n)
        for s in own:
            codes[s] = code
            code += 1
            values.append(int(s))
        bits.append(len(own))
        code <<= 1
    return codes, bits, values


def text_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code lengths (AC symbols) and (DC symbols) for running text: chances of each size by the ranks of its bytes, and of runs of spaces."""
    size = np.array([0, 23, 26, 27, 12, 3, 4, 4, 1]) / 100  # of sizes 1 to 8
    ac = np.zeros(256)
    for run in range(16):
        for s in range(1, 9):
            ac[16 * run + s] = 0.84 * 0.16**run * size[s]
    ac[0x00], ac[0xF0] = 0.005, 1e-4
    return huffman_lengths(np.rint(ac * 1e6).astype(np.int64) + (ac > 0)), huffman_lengths(np.rint(np.concatenate([[0.16], size[1:] * 0.84]) * 1e6).astype(np.int64))


_AC_LENGTHS, _DC_LENGTHS = text_tables()
(_AC_CODES, *_AC_TABLE), (_DC_CODES, *_DC_TABLE) = canonical(_AC_LENGTHS), canonical(_DC_LENGTHS)


def _symbols(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks of coefficients (n x 64), in scan order: values of codes with their extra bits, lengths, and symbols of each block."""
    n = len(c)
    blocks, places = np.nonzero(c[:, 1:])
    places += 1
    value = c[blocks, places].astype(np.int64)
    per = np.bincount(blocks, minlength=n)
    tails = np.cumsum(per)
    before = np.empty(len(blocks), np.int64)
    before[1:] = places[:-1]
    before[(tails - per)[per > 0]] = 0
    run = places - before - 1
    long = run >> 4  # runs over 15 are told in sixteens
    last = np.zeros(n, np.int64)
    last[per > 0] = places[tails[per > 0] - 1]
    ends = (last < 63).astype(np.int64)
    taken = np.cumsum(long + 1)
    upto = np.concatenate([[0], taken])
    in_block = upto[tails] - upto[tails - per] + 1 + ends
    begin = np.cumsum(in_block) - in_block
    at = begin[blocks] + taken - upto[(tails - per)[blocks]]
    total = int(in_block.sum())
    bits, length = np.full(total, _AC_CODES[0xF0]), np.full(total, _AC_LENGTHS[0xF0])
    size = _SIZE[np.abs(value)]
    symbol = ((run & 15) << 4) + size
    bits[at] = (_AC_CODES[symbol] << size) | np.where(value < 0, value + (1 << size) - 1, value)
    length[at] = _AC_LENGTHS[symbol] + size
    dc = c[:, 0].astype(np.int64)
    size = _SIZE[np.abs(dc)]
    bits[begin] = (_DC_CODES[size] << size) | np.where(dc < 0, dc + (1 << size) - 1, dc)
    length[begin] = _DC_LENGTHS[size] + size
    close = (begin + in_block - 1)[ends > 0]
    bits[close], length[close] = _AC_CODES[0], _AC_LENGTHS[0]
    return bits, length, in_block


def _packed(bits: np.ndarray, length: np.ndarray, in_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks, each padded with ones to whole bytes, and the number of bytes of each."""
    upto = np.concatenate([[0], np.cumsum(length)])
    stop = np.cumsum(in_block)
    per = upto[stop] - upto[stop - in_block]
    size = (per + 7) >> 3
    start = (np.cumsum(size) - size) << 3
    at = upto[:-1] + np.repeat(start - upto[stop - in_block], in_block)
    word, wide = at >> 5, bits.astype(np.uint64) << (64 - (at & 31) - length).astype(np.uint64)
    out = np.zeros((int(size.sum()) >> 2) + 3, np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))  # codes of one 32-bit word lie together
    out[word[edge]] += np.add.reduceat(wide >> np.uint64(32), edge)
    out[word[edge] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), edge)
    data = out.astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    data[(start >> 3) + size - 1] |= ((1 << (size * 8 - per)) - 1).astype(np.uint8)
    return data, size


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of 64 bytes), whose coefficients are the payload. A comment has its length."""
    heads, sizes = [], []
    for p in payloads:
        n = len(p) // UNIT
        across = max(1, min(8191, int(np.ceil(np.sqrt(n)))))
        down = -(-n // across)
        if down > 8191:
            raise ValueError("a JPEG holds at most 8191 x 8191 blocks")
        head = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0))]
        head += [_segment(0xC4, bytes([0x00, *_DC_TABLE[0], *_DC_TABLE[1]])), _segment(0xC4, bytes([0x10, *_AC_TABLE[0], *_AC_TABLE[1]])), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))]
        heads.append(b"".join(head))
        sizes.append(across * down)
    fill = bytes([int(np.flatnonzero(_RANK == 0)[0])])  # blocks of zero coefficients up to a whole row
    units = np.frombuffer(b"".join(x for p, n in zip(payloads, sizes, strict=True) for x in (p, fill * (n * UNIT - len(p)))), np.uint8).reshape(-1, UNIT)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    number = np.arange(len(units)) - np.repeat(bounds[:-1], sizes)
    parts, ends = [], []
    for i in range(0, len(units), LANES):
        data, size = _packed(*_symbols(_TO_COEFFICIENT[units[i : i + LANES]]))
        own = number[i : i + LANES]
        begins = np.cumsum(size) - size
        # A restart marker before each block but an image's first; a zero after each 0xFF of data. At
        # one place the zero comes before the marker: np.insert keeps the order given.
        ff = np.flatnonzero(data == 0xFF)
        rst = np.stack([np.full((own > 0).sum(), 0xFF), 0xD0 + (own[own > 0] - 1) % 8], 1).ravel()
        parts.append(np.insert(data, np.concatenate([ff + 1, np.repeat(begins[own > 0], 2)]), np.concatenate([np.zeros(len(ff)), rst]).astype(np.uint8)))
        ends.append(size + np.bincount(np.searchsorted(begins, ff, side="right") - 1, minlength=len(size)) + 2 * (own > 0))
    scan, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(ends))])
    return [b"".join((h, scan[upto[a] : upto[b]].tobytes(), b"\xff\xd9")) for h, a, b in zip(heads, bounds[:-1], bounds[1:], strict=True)]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


@dataclass
class Image:
    """What the markers say. ``scan``: bytes of the scan; ``mcus``: blocks of one MCU as (component, DC table, AC table)."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    components: list = field(default_factory=list)
    restart: int = 0
    scan: bytes = b""
    order: list = field(default_factory=list)

    @property
    def mcu_size(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return (8, 8) if len(self.components) == 1 else (8 * h, 8 * v)

    @property
    def mcus(self) -> tuple[int, int]:
        w, h = self.mcu_size
        return -(-self.width // w), -(-self.height // h)

    @property
    def blocks(self) -> list[tuple[int, int, int]]:
        out = []
        for cid, dc, ac in self.order:
            i = next(k for k, c in enumerate(self.components) if c[0] == cid)
            n = 1 if len(self.components) == 1 else self.components[i][1] * self.components[i][2]
            out += [(i, dc, ac)] * n
        return out


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG with one scan. Anything else raises ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    im, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            im.comment = body
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                im.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else ">u1", 64, i + 1).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            _, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                bits = list(body[i + 1 : i + 17])
                im.tables[body[i]] = (bits, list(body[i + 17 : i + 17 + sum(bits)]))
                i += 17 + sum(bits)
        elif marker == 0xDD:
            im.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            if not im.components or n != len(im.components):
                raise ValueError("scans of single components are not supported")
            im.order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise ValueError("the scan has no end")
            im.scan = data[at:end]
            return im
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
    raise ValueError("no scan")


def lookup(table: tuple[list[int], list[int]]) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol of the code that it begins with; 0 if none."""
    out, code, i = np.zeros(1 << 16, np.int32), 0, 0
    bits, values = table
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | values[i]
            code += 1
            i += 1
        code <<= 1
    return out


def intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and restart markers, and where each interval begins in it."""
    d = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(d[:-1] == 0xFF)
    nxt = d[ff + 1]
    rst = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep = np.ones(len(d), bool)
    keep[ff[nxt == 0] + 1] = False
    keep[rst] = keep[rst + 1] = False
    begins = np.concatenate([[0], rst + 2])
    return d[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def _decode_lanes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, blocks: list[tuple[int, int, int]], tables: dict[int, np.ndarray]) -> np.ndarray:
    """Coefficients (intervals x blocks x 64, scan order) of intervals of ``counts`` blocks; all lanes take a symbol at a time."""
    n, most, bytes_ = len(starts), int(counts.max()), len(data)
    d = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    five = (d[:-4] << 32) | (d[1:-3] << 24) | (d[2:-2] << 16) | (d[3:-1] << 8) | d[4:]  # 40 bits from each byte on
    out = np.zeros((n, most, 64), np.int16)
    pos, pred = starts.astype(np.int64) << 3, np.zeros((n, 1 + max(b[0] for b in blocks)), np.int64)

    def take(p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the codes at bits ``p``: symbols, values of their extra bits, places after them."""
        w = (five[np.minimum(p >> 3, bytes_)] >> (8 - (p & 7))) & 0xFFFFFFFF
        code = table[w >> 16]
        if not code.all():
            raise ValueError("a code isn't in its table")
        length, symbol = code >> 8, code & 0xFF
        size = symbol & 15
        value = ((w << length) & 0xFFFFFFFF) >> (32 - size)
        value -= np.where((value << 1) >> size == 0, (1 << size) - 1, 0)
        return symbol, value, p + length + size

    flat = out.reshape(-1)
    for b in range(most):
        component, dc, ac = blocks[b % len(blocks)]
        live = np.flatnonzero(counts > b)
        _, diff, p = take(pos[live], tables[dc])
        pred[live, component] += diff
        out[live, b, 0] = pred[live, component]
        k, base = np.ones(len(live), np.int64), (live * most + b) * 64
        while len(live):
            symbol, value, p = take(p, tables[0x10 + ac])
            k += symbol >> 4
            put = (symbol & 15) > 0
            if not put.all():
                flat[(base + k)[put & (k < 64)]] = value[put & (k < 64)]
            elif k.max() < 64:
                flat[base + k] = value
            if (k[put] > 63).any():
                raise ValueError("a block has too many coefficients")
            k += 1
            done = (symbol == 0) | (k > 63)
            if done.any():
                pos[live[done]] = p[done]
                more = ~done
                live, k, p, base = live[more], k[more], p[more], base[more]
        if (pos > (bytes_ << 3) + 7).any():
            raise ValueError("the scan is cut")
    return out


def decode(images: list[Image]) -> list[np.ndarray]:
    """Quantized coefficients (blocks x 64, scan order) of each image. Images with equal tables and layout are decoded side by side."""
    alike: dict[tuple, list[int]] = {}
    for j, im in enumerate(images):
        size = im.mcus[0] * im.mcus[1] * len(im.blocks)
        per = im.restart * len(im.blocks) or size
        used = tuple(sorted((t, tuple(map(tuple, im.tables[t]))) for t in {d for _, d, _ in im.order} | {0x10 + a for _, _, a in im.order}))
        alike.setdefault((tuple(im.blocks), min(per, size), used), []).append(j)
    out: list = [None] * len(images)
    for (blocks, per, used), own in alike.items():
        tables = {t: lookup(x) for t, x in used}
        datas, starts, counts, totals, at = [], [], [], [], 0
        for j in own:
            data, begins = intervals(images[j].scan)
            total = images[j].mcus[0] * images[j].mcus[1] * len(blocks)
            c = np.full(len(begins), per)
            c[-1] = total - per * (len(begins) - 1)
            if not 0 < c[-1] <= per:
                raise ValueError("restart markers are missing")
            datas.append(data)
            starts.append(begins + at)
            counts.append(c)
            totals.append(total)
            at += len(data)
        data, start, count = np.concatenate(datas), np.concatenate(starts), np.concatenate(counts)
        lanes, parts = max(1, LANES // per), []
        for i in range(0, len(start), lanes):
            s, c = start[i : i + lanes], count[i : i + lanes]
            stop = int(start[i + lanes]) if i + lanes < len(start) else len(data)
            got = _decode_lanes(data[int(s[0]) : stop], s - s[0], c, list(blocks), tables)
            parts.append(got.reshape(-1, 64) if (c == got.shape[1]).all() else got[np.arange(got.shape[1])[None, :] < c[:, None]])
        for j, part in zip(own, np.split(np.concatenate(parts), np.cumsum(totals)[:-1]), strict=True):
            out[j] = part
    return out


def thumbnail(im: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block of the first component from its DC term alone, as 0 to 255."""
    across, down = im.mcus
    h, v = (1, 1) if len(im.components) == 1 else im.components[0][1:3]
    size = len(im.blocks)
    first = next(i for i, b in enumerate(im.blocks) if b[0] == 0)
    dc = coefficients[:, 0].reshape(down, across, size)[:, :, first : first + h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grey = dc.astype(np.float64) * im.quant[im.components[0][3]][0] / 8 + 128
    return np.clip(np.rint(grey[: -(-im.height // 8), : -(-im.width // 8)]), 0, 255).astype(np.uint8)


def average_hash(grey: np.ndarray, side: int = 8) -> int:
    """64 bits: whether each cell of an 8 x 8 grid over the thumbnail is brighter than the grid's mean. Small thumbnails are repeated."""
    ys, xs = np.linspace(0, grey.shape[0], side + 1), np.linspace(0, grey.shape[1], side + 1)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)
    y0, x0 = np.floor(ys[:-1]).astype(int), np.floor(xs[:-1]).astype(int)
    y1, x1 = np.maximum(np.ceil(ys[1:]).astype(int), y0 + 1), np.maximum(np.ceil(xs[1:]).astype(int), x0 + 1)
    cells = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)
    return int("".join("1" if b else "0" for b in (cells > cells.mean()).ravel()), 2)


def payload_of(im: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    word, _, size = im.comment.partition(b" ")
    if word != b"payload":
        raise ValueError("the image stores no payload")
    return _FROM_COEFFICIENT[coefficients.astype(np.int32) + 128].tobytes()[: int(size)]


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and its payload: filled with zeros to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_ROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
_ROW_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(keys: list, payloads: list[bytes]) -> pa.RecordBatch:
        ids, sizes = zip(*keys, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(encode_many(payloads), pa.binary())], schema=_STORED)

    for b in batches:
        keys, payloads, size = [], [], 0
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            n, payload = padded(text.as_py())
            keys.append((doc_id.as_py(), n))
            payloads.append(payload)
            size += len(payload)
            if size >= TOGETHER:
                yield made(keys, payloads)
                keys, payloads, size = [], [], 0
        if keys:
            yield made(keys, payloads)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(keys: list, media: list[bytes]) -> pa.RecordBatch:
        images, rows = [parse(m) for m in media], []
        for (doc_id, n), data, im, coefficients in zip(keys, media, images, decode(images), strict=True):
            payload, grey = payload_of(im, coefficients), thumbnail(im, coefficients)
            feature = f"{im.width}x{im.height}:{average_hash(grey):016x}:{hashlib.sha256(grey.tobytes()).hexdigest()[:16]}"
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, im.width, im.height))
        return pa.RecordBatch.from_pydict(dict(zip(_ROW.names, zip(*rows, strict=True), strict=True)), schema=_ROW)

    for b in batches:
        keys, media, size = [], [], 0
        for doc_id, n, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
            keys.append((doc_id.as_py(), n.as_py()))
            media.append(data.as_py())
            size += len(media[-1])
            if size >= TOGETHER:
                yield made(keys, media)
                keys, media, size = [], [], 0
        if keys:
            yield made(keys, media)


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, media (a baseline JPEG) of each row of ``docs`` (doc_id, text; other columns are ignored), as a table at ``path``.

    A null text is empty: one block of zeros. A very long text is one image of many blocks. Repeated
    rows are each stored, equal texts equally; no rows give an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), path)


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and payload digests of a ``store_media`` table, each row from its stored bytes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _ROW_DDL)


def media_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store all of ``docs`` as images, read them back, and describe each by what was read."""
    return media_features(store_media(docs, scratch(spark) + "/media"))
