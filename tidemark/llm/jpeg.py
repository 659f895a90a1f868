"""Baseline JPEG in numpy: marker parsing, Huffman coding of scans, and DC-only luminance thumbnails.

Many images are decoded at once: every restart interval is a lane of its own, and all lanes decode one
Huffman symbol a step. Payloads are written with one block to a restart interval, so lanes are short.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Samples of a block, and the largest side of an image in blocks.
BLOCK, SIDE = 64, 8191
#: Blocks coded at a time; a larger image is coded in slices.
SLICE = 8192


def code_lengths() -> dict[str, dict[int, int]]:
    """Our Huffman code lengths: short for the coefficient sizes that text bytes less 128 have most often.

    dc: all sizes 0-11 alike. ac: symbol run*16+size; run 0 gets 3 or 4 bits, every other run/size pair,
    end of block and run of 16 get 10. The sums of 2**-length stay under 1, as baseline JPEG demands.
    """
    ac = {size: 3 for size in (3, 4, 5, 7)} | {size: 4 for size in (1, 2, 6, 8)} | {9: 10, 10: 10, 0x00: 10, 0xF0: 10}
    ac |= {run * 16 + size: 10 for run in range(1, 16) for size in range(1, 11)}
    return {"dc": {size: 4 for size in range(12)}, "ac": ac}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """A DHT segment's counts by length and symbols, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in order:
        n = lengths[s]
        code <<= n - last
        codes[s] = (code, n)
        counts[n - 1] += 1
        code, last = code + 1, n
    return counts, order, codes


@lru_cache(maxsize=1)
def _tables():
    """Code and length by symbol for our dc and ac tables, and the header segments that carry them."""
    found, segments = {}, b""
    for k, (name, lengths) in enumerate(code_lengths().items()):
        counts, symbols, codes = canonical(lengths)
        code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, (c, n) in codes.items():
            code[s], size[s] = c, n
        found[name] = (code, size)
        body = bytes([k << 4]) + bytes(counts) + bytes(symbols)
        segments += b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body
    return found, segments


def header(width: int, height: int, n_payload: int) -> bytes:
    """All segments before the scan's data of a greyscale image with one block to a restart interval.

    A comment segment holds the payload's length. Every quantizer is 8 for DC, so a thumbnail pixel is
    the block's first byte, and 1 for AC.
    """
    quant = bytes([0, 8]) + b"\1" * 63
    out = b"\xff\xd8" + b"\xff\xfe" + struct.pack(">HQ", 10, n_payload)
    out += b"\xff\xdb" + struct.pack(">H", 67) + quant
    out += b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
    out += _tables()[1] + b"\xff\xdd" + struct.pack(">HH", 4, 1)
    return out + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])


def _size_of(v: np.ndarray) -> np.ndarray:
    """Bits of a coefficient's magnitude."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def encode_blocks(coefficients: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Scan data of blocks (n, 64) in zigzag order, each an interval of its own, and each one's length.

    number: each block's place in its image; its restart marker follows from it (none after an image's
    last block is wanted: the caller drops it).
    """
    found, _ = _tables()
    n = len(coefficients)
    c = coefficients.astype(np.int64)
    size = _size_of(c)
    # places of zeros before each coefficient since the last that isn't
    at = np.where(c != 0, np.arange(64), 0)
    at[:, 0] = 0
    last = np.maximum.accumulate(at, axis=1)
    run = np.arange(64)[None, :] - np.concatenate((np.zeros((n, 1), np.int64), last[:, :-1]), 1) - 1
    coded = c != 0
    coded[:, 0] = True
    symbol = np.where(np.arange(64) == 0, size, (run & 15) * 16 + size)
    dc_code, dc_len = found["dc"]
    ac_code, ac_len = found["ac"]
    zrl = np.where(coded & (np.arange(64) > 0), run >> 4, 0)  # runs of 16 zeros before it
    code = np.where(np.arange(64) == 0, dc_code[symbol], ac_code[symbol])
    length = np.where(np.arange(64) == 0, dc_len[symbol], ac_len[symbol])
    value = np.where(c < 0, c + (1 << size) - 1, c)
    bits, total = (code << size) | value, length + size
    block, place = np.nonzero(coded)
    b, t = bits[block, place], total[block, place]
    if zrl.any():
        many = zrl[block, place]
        rep = np.repeat(np.arange(len(b)), many + 1)
        ends = np.cumsum(many + 1) - 1
        nb, nt = np.full(len(rep), ac_code[0xF0]), np.full(len(rep), ac_len[0xF0])
        nb[ends], nt[ends] = b, t
        b, t, block = nb, nt, block[rep]
    short = last[:, -1] < 63  # end of block
    if short.any():
        where = np.searchsorted(block, np.flatnonzero(short), "right")
        b, t, block = np.insert(b, where, ac_code[0]), np.insert(t, where, ac_len[0]), np.insert(block, where, np.flatnonzero(short))
    used = np.bincount(block, t, n).astype(np.int64)
    pad = -used % 8  # filled with ones
    ends = np.searchsorted(block, np.arange(n), "right")
    b, t = np.insert(b, ends, (1 << pad) - 1), np.insert(t, ends, pad)
    stop = np.cumsum(t)
    total_bits = int(stop[-1])
    shift = np.repeat(stop, t) - np.arange(1, total_bits + 1)
    raw = np.packbits(((np.repeat(b, t) >> shift) & 1).astype(np.uint8))
    # a zero follows every 0xff of the data, and a restart marker every block
    block_end = np.cumsum((used + pad) // 8)
    ff = np.flatnonzero(raw == 0xFF)
    stuffed = np.searchsorted(ff, block_end)
    marks = np.repeat(block_end, 2)
    fill = np.empty(2 * n, np.uint8)
    fill[0::2], fill[1::2] = 0xFF, 0xD0 + number % 8
    where = np.concatenate((ff + 1, marks))
    what = np.concatenate((np.zeros(len(ff), np.uint8), fill))
    order = np.argsort(where, kind="stable")
    out = np.insert(raw, where[order], what[order])
    lengths = np.diff(np.concatenate(([0], block_end + stuffed + 2 * np.arange(1, n + 1))))
    return out.tobytes(), lengths


def geometry(blocks: int) -> tuple[int, int]:
    """Blocks across and down of an image with room for so many."""
    across = min(SIDE, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of 64 bytes): byte k of a block less 128 is its
    k-th quantized coefficient in zigzag order. Blocks beyond the payload are zero."""
    shapes = [geometry(len(p) // BLOCK) for p in payloads]
    out = [bytearray(header(8 * w, 8 * h, len(p))) for p, (w, h) in zip(payloads, shapes)]
    jobs, held = [], 0  # (image, first block, blocks)
    for i, (w, h) in enumerate(shapes):
        for a in range(0, w * h, SLICE):
            jobs.append((i, a, min(SLICE, w * h - a)))
    k = 0
    while k < len(jobs):
        batch, held = [], 0
        while k < len(jobs) and held < SLICE:
            batch.append(jobs[k])
            held += jobs[k][2]
            k += 1
        coefficients, numbers = [], []
        for i, a, n in batch:
            part = np.frombuffer(payloads[i], np.uint8)[a * BLOCK : (a + n) * BLOCK].astype(np.int16).reshape(-1, BLOCK) - 128
            coefficients.append(np.concatenate((part, np.zeros((n - len(part), BLOCK), np.int16))))
            numbers.append(np.arange(a, a + n))
        data, lengths = encode_blocks(np.concatenate(coefficients), np.concatenate(numbers))
        ends = np.cumsum(lengths)
        at = 0
        for i, a, n in batch:
            end = int(ends[at + n - 1])
            start = int(ends[at - 1]) if at else 0
            out[i] += data[start:end]
            if a + n == shapes[i][0] * shapes[i][1]:
                del out[i][-2:]  # no marker after the last block
            at += n
    return [bytes(x) + b"\xff\xd9" for x in out]


@dataclass
class Image:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantizer
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, np.ndarray] = field(default_factory=dict)  # class << 4 | id -> table
    tables: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's index, dc table, ac table
    restart: int = 0
    comment: bytes = b""
    data: tuple[int, int] = (0, 0)

    def schedule(self) -> list[int]:
        """Scan component of each block of one unit."""
        if len(self.scan) == 1:
            return [0]
        return [k for k, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][1] * self.components[c][2])]

    def units(self) -> tuple[int, int]:
        """Units across and down."""
        most_x, most_y = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:
            _, x, y, _ = self.components[self.scan[0][0]]
            w, h = -(-self.width * x // most_x), -(-self.height * y // most_y)
            return -(-w // 8), -(-h // 8)
        return -(-self.width // (8 * most_x)), -(-self.height // (8 * most_y))


@lru_cache(maxsize=64)
def _lookup(segment: bytes) -> np.ndarray:
    """For every 16 bits to come: code length << 8 | symbol; 0 where no code fits."""
    table, code, k = np.zeros(65536, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(segment[n - 1]):
            first = code << (16 - n)
            table[first : first + (1 << (16 - n))] = n << 8 | segment[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def parse(media: bytes) -> Image:
    """Read the markers up to the end of the first scan; baseline only."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if media[at] != 0xFF:
            raise ValueError("no marker where one must be")
        while media[at + 1] == 0xFF:
            at += 1
        marker = media[at + 1]
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                image.quantizers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("8-bit samples only")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    image.data = (at, _scan_end(media, at))
    return image


def _scan_end(media: bytes, at: int) -> int:
    """Where the next marker other than a restart stands."""
    data = np.frombuffer(media, np.uint8)
    ff = np.flatnonzero(data[at:-1] == 0xFF) + at
    after = data[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    return int(ends[0]) if len(ends) else len(media)


def decode_scan(medias: list[bytes], images: list[Image]) -> list[np.ndarray]:
    """Quantized coefficients of each image's scan, (blocks in scan order, 64) in zigzag order, DC undifferenced."""
    tables: dict[bytes, int] = {}
    lane_start, lane_blocks, lane_image, lane_first, plans = [], [], [], [], []
    clean, offset, total = [], 0, 0
    for i, (media, image) in enumerate(zip(medias, images)):
        data = np.frombuffer(media, np.uint8)[image.data[0] : image.data[1]]
        ff = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
        after = data[ff + 1] if len(ff) else np.zeros(0, np.uint8)
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[ff[after == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        starts = np.concatenate(([0], np.cumsum(keep)[marks] if len(marks) else []))
        schedule = image.schedule()
        across, down = image.units()
        units = across * down
        each = image.restart or units
        n_lanes = -(-units // each)
        if len(starts) < n_lanes:
            raise ValueError("restart markers are missing")
        pairs = [(tables.setdefault(image.tables[d], len(tables)), tables.setdefault(image.tables[16 + a], len(tables))) for _, d, a in image.scan]
        plans.append((total, units * len(schedule), schedule, pairs))
        lane_start.append((starts[:n_lanes].astype(np.int64) + offset) * 8)
        sizes = np.minimum(each, units - each * np.arange(n_lanes)) * len(schedule)
        lane_blocks.append(sizes)
        lane_first.append(total + np.cumsum(sizes) - sizes)
        lane_image.append(np.full(n_lanes, i))
        clean.append(data[keep])
        offset += int(keep.sum())
        total += units * len(schedule)
    stream = np.concatenate([*clean, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    ahead = np.zeros(offset + 1, np.uint64)  # 40 bits from each byte on
    for k in range(5):
        ahead = ahead << np.uint64(8) | stream[k : k + offset + 1]
    codes = np.concatenate([_lookup(t) for t in tables])
    longest = max(len(p[2]) for p in plans)
    dc, ac = (np.zeros((len(plans), longest), np.int64) for _ in range(2))
    for i, (_, _, schedule, pairs) in enumerate(plans):
        for k, c in enumerate(schedule):
            dc[i, k], ac[i, k] = pairs[c][0] << 16, pairs[c][1] << 16
    period = np.array([len(p[2]) for p in plans])
    out = np.zeros(total * 64, np.int16)
    bit, left, first, image = np.concatenate(lane_start), np.concatenate(lane_blocks), np.concatenate(lane_first), np.concatenate(lane_image)
    k, turn = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    live = np.flatnonzero(left > 0)
    bit, left, base, image, k, turn = bit[live], left[live], first[live] * 64, image[live], k[live], turn[live]
    simple = longest == 1
    while len(bit):
        window = (ahead[np.minimum(bit >> 3, offset)] << (bit & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        peek = (window >> np.uint64(24)).astype(np.int64)
        start = k == 0
        table = np.where(start, dc[image, turn], ac[image, turn]) if not simple else np.where(start, dc[image, 0], ac[image, 0])
        entry = codes[table + peek].astype(np.int64)
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("no such Huffman code")
        size = np.where(start, symbol, symbol & 15)
        skip = np.where(start, 0, symbol >> 4)
        extra = (window >> (40 - length - size).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)
        value = extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0)
        end = ~start & (symbol == 0)
        k += skip
        put = size > 0
        if (k[put] > 63).any():
            raise ValueError("a block has more than 64 coefficients")
        out[(base + k)[put]] = value[put]
        bit += length + size
        k += 1
        done = end | (k > 63)
        if done.any():
            left -= done
            base += 64 * done
            turn = np.where(done, (turn + 1) % period[image], turn) if not simple else turn
            k[done] = 0
            if not left.all():
                go = left > 0
                bit, left, base, image, k, turn = bit[go], left[go], base[go], image[go], k[go], turn[go]
    blocks, found = out.reshape(-1, 64), []
    for i, (at, n, schedule, _) in enumerate(plans):
        mine = blocks[at : at + n]
        each = (images[i].restart or images[i].units()[0] * images[i].units()[1]) * len(schedule)
        if each > 1:  # DC values are differences within an interval and component
            which = np.tile(schedule, n // len(schedule))
            interval = np.arange(n) // each
            for c in range(len(images[i].scan)):
                rows = np.flatnonzero(which == c)
                sums = np.cumsum(mine[rows, 0].astype(np.int64))
                new = np.flatnonzero(np.diff(interval[rows], prepend=-1))
                before = np.concatenate(([0], sums))[new]
                mine[rows, 0] = sums - np.repeat(before, np.diff(np.append(new, len(rows))))
        found.append(mine)
    return found


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """One luminance pixel for each block of the first component: its DC over 8, plus 128."""
    schedule = image.schedule()
    rows = [k for k, c in enumerate(schedule) if c == 0]
    component = image.components[image.scan[0][0]]
    dc = blocks[:, 0].reshape(-1, len(schedule))[:, rows].astype(np.int64) * int(image.quantizers[component[3]][0])
    across, down = image.units()
    x, y = (component[1], component[2]) if len(image.scan) > 1 else (1, 1)
    pixels = np.clip(np.rint(dc / 8) + 128, 0, 255)
    grid = pixels.reshape(down, across, y, x).transpose(0, 2, 1, 3).reshape(down * y, across * x)
    return grid.astype(np.uint8)


def difference_hash(grid: np.ndarray, side: int = 8) -> int:
    """64 bits: whether each cell of an 8 x 9 reduction is darker than the next one."""
    h, w = grid.shape
    ys, xs = np.arange(side) * h // side, np.arange(side + 1) * w // (side + 1)
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = grid.astype(float).cumsum(0).cumsum(1)
    y2, x2 = np.maximum(ys + 1, np.append(ys[1:], h)), np.maximum(xs + 1, np.append(xs[1:], w))
    cells = sums[y2][:, x2] - sums[ys][:, x2] - sums[y2][:, xs] + sums[ys][:, xs]
    means = cells / ((y2 - ys)[:, None] * (x2 - xs)[None, :])
    return int("".join("1" if b else "0" for b in (means[:, :-1] < means[:, 1:]).ravel()), 2)


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    """The payload of an image made by encode_payloads()."""
    n = struct.unpack(">Q", image.comment)[0]
    return (blocks.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()
