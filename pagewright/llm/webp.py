"""Lossless WebP images: a writer for opaque images and a reader for any lossless file.

The reader takes prefix codes (simple and normal), back-references, the colour cache, meta prefix codes and the four
transforms (predictor, cross-colour, subtract-green, palette). ``read_many`` decodes files without meta codes
in step with each other, a symbol of each per round, with numpy; ``read`` handles one file of any kind. The writer takes the
predictor, cross-colour, back-references, the colour cache and normal codes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
GREENS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
BLACK = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LONGEST_COPY = 4096
#: an image of zeros alone: no cache, and five codes of the symbol 0
NOTHING = 0b000100010001000100010
#: files decoded in step
LANES = 4096
#: bits of the longest code in a file that is decoded in step
LONGEST_CODE = 11
#: near offsets (dx left, dy up), by distance, then by |dx|, left before right
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Corrupt(ValueError):
    """The bytes are not a lossless WebP file."""


class Bits:
    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.window, self.base = 0, -1

    def peek(self, n: int) -> int:
        # a long integer is cut into windows, so that a shift costs the same everywhere
        if self.base < 0 or self.at - self.base > 3000:
            self.base = self.at
            self.window = (self.value >> self.at) & ((1 << 4096) - 1)
        return (self.window >> (self.at - self.base)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise Corrupt("the bit stream ends early")
        out = self.peek(n)
        self.at += n
        return out


class Code:
    """A canonical prefix code; ``table[next bits]`` is symbol << 4 | length."""

    def __init__(self, lengths: list[int] | bytearray):
        n = np.array(lengths, np.int64)
        used = n.nonzero()[0]
        if len(used) < 2:
            self.bits, self.table = 0, [int(used[0]) << 4 if len(used) else 0]
            return
        n = n[used]
        self.bits = int(n.max())
        share = 1 << (self.bits - n)
        if share.sum() != 1 << self.bits:
            raise Corrupt("a prefix code isn't complete")
        order = n.argsort(kind="stable")
        by_code = (used << 4 | n)[order].repeat(share[order])
        self.table = by_code[reversals(self.bits)]  # the stream has a code's first bit lowest

    @cached_property
    def listed(self) -> list[int]:
        return np.asarray(self.table).tolist()

    def next(self, bits: Bits) -> int:
        if not self.bits:
            return self.table[0] >> 4
        found = self.listed[bits.peek(self.bits)]
        bits.at += found & 15
        if bits.at > bits.size:
            raise Corrupt("the bit stream ends early")
        return found >> 4


@lru_cache(16)
def reversals(bits: int) -> np.ndarray:
    """Every number below 2**bits with its bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def reverse(code: int, n: int) -> int:
    return int(reversals(n)[code])


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol to (length, code), codes in order of length and symbol"""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (n, code)
        code, last = code + 1, n
    return out


@lru_cache(64)
def _length_code(count: int, packed: int) -> Code:
    """The code of code lengths, whose own lengths take three bits each."""
    own = [0] * 19
    for i in range(count):
        own[CODE_ORDER[i]] = packed >> 3 * i & 7
    return Code(own)


@lru_cache(2048)
def _single(symbol: int, size: int) -> Code:
    lengths = [0] * size
    lengths[symbol] = 1
    return Code(lengths)


#: bits that ``_own_steps`` looks up together, and the most code lengths that these hold
OWN_STEP, OWN_MOST = 14, 5


@lru_cache(1)
def _own_steps() -> list[tuple[bytes, int, int]]:
    """For the next ``OWN_STEP`` bits in the writer's own code of code lengths: the lengths that they hold, with runs of 0
    spread, their bits, and their number of symbols."""
    code, out = Code(_OWN), []
    for bits in range(1 << OWN_STEP):
        own, at, n = b"", 0, 0
        while n < OWN_MOST:
            found = code.listed[bits >> at & (1 << code.bits) - 1]
            symbol, more = found >> 4, {17: 3, 18: 7}.get(found >> 4, 0)
            end = at + (found & 15) + more
            if end > OWN_STEP:
                break
            value = bits >> end - more & (1 << more) - 1
            own += bytes([symbol]) if symbol < 16 else bytes(value + (3 if symbol == 17 else 11))
            at, n = end, n + 1
        out.append((own, at, n))
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if several else [])
        for s in symbols:
            if s >= size:
                raise Corrupt("a symbol is out of range")
            lengths[s] = 1
        return Code(lengths) if several else _single(symbols[0], size)
    count = 4 + bits.read(4)
    packed = bits.read(3 * count)
    code, at, last = _length_code(count, packed), 0, 8
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if left < size and count == 19 and packed == _OWN_PACKED:
        # several lengths at a time, up to the last few
        steps, rest, at_, parts, n = _own_steps(), left, bits.at, [], 11 * left
        window = bits.value >> at_ & (1 << n) - 1
        while rest >= OWN_MOST:
            own, used, n = steps[window & (1 << OWN_STEP) - 1]
            parts.append(own)
            window >>= used
            at_ += used
            rest -= n
        own = b"".join(parts)
        if len(own) <= size and at_ <= bits.size:
            bits.at, left, at = at_, rest, len(own)
            lengths[:at] = own
    # a few hundred bits are taken off the stream at a time
    table, mask, window, held, start = code.listed, (1 << code.bits) - 1, 0, 0, bits.at
    while at < size and left:
        left -= 1
        if held < 16:
            bits.at = start
            window, held = bits.peek(512), 512
        found = table[window & mask]
        n, used = found >> 4, found & 15
        if n < 16:
            lengths[at] = n
            at, last = at + 1, n or last
        else:
            window >>= used
            value, least, more = (last, 3, 2) if n == 16 else (0, 3, 3) if n == 17 else (0, 11, 7)
            count = least + (window & (1 << more) - 1)
            if at + count > size:
                raise Corrupt("code lengths run over")
            if value:
                lengths[at : at + count] = [value] * count
            at += count
            window >>= more
            held -= used + more
            start += used + more
            continue
        window >>= used
        held -= used
        start += used
    bits.at = start
    if start > bits.size:
        raise Corrupt("the bit stream ends early")
    return Code(lengths)


def _spread(code: int, bits: Bits) -> int:
    """The value of a length or distance prefix."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _distance(value: int, width: int) -> int:
    if value > len(NEAR):
        return value - len(NEAR)
    dx, dy = NEAR[value - 1]
    return max(1, dx + dy * width)


def _copy(out: list[int], length: int, far: Code, bits: Bits, width: int, total: int) -> None:
    n, at = _spread(length, bits), len(out)
    back = _distance(_spread(far.next(bits), bits), width)
    if back > at or at + n > total:
        raise Corrupt("a back-reference leaves the image")
    for i in range(at - back, at - back + n):
        out.append(out[i])


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """ARGB values, row by row."""
    if not main and bits.at + 21 <= bits.size and bits.peek(21) == NOTHING:
        bits.at += 21
        return [0] * (width * height)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("the colour cache is too large")
    tile, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        groups_of = [p >> 8 & 0xFFFF for p in _read_pixels(bits, across, -(-height >> tile), False)]
        n_groups = max(groups_of) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(bits, n) for n in (GREENS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(n_groups)]
    out: list[int] = []
    cache, cached, total = [0] * cache_size, 0, width * height
    green, red, blue, alpha, far = groups[0]
    if n_groups == 1 and not (cache_size or red.bits or blue.bits or alpha.bits):
        rest = alpha.next(bits) << 24 | red.next(bits) << 16 | blue.next(bits)
        while len(out) < total and (s := green.next(bits)) < GREENS:
            out.append(rest | s << 8)
        if len(out) < total:
            _copy(out, s - GREENS, far, bits, width, total)
    while len(out) < total:
        at = len(out)
        if groups_of is not None:
            green, red, blue, alpha, far = groups[groups_of[(at // width >> tile) * across + (at % width >> tile)]]
        s = green.next(bits)
        if s < GREENS:
            r, b = red.next(bits), blue.next(bits)
            out.append(alpha.next(bits) << 24 | r << 16 | s << 8 | b)
        elif s < GREENS + LENGTHS:
            _copy(out, s - GREENS, far, bits, width, total)
        else:
            while cached < at:
                cache[(out[cached] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - GREENS - LENGTHS])
    return out


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _mean(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _full(left: int, top: int, corner: int) -> int:
    return _joined([_clamp(a + b - c) for a, b, c in zip(_channels(left), _channels(top), _channels(corner))])


def _half(mean: int, corner: int) -> int:
    return _joined([_clamp(a + int((a - c) / 2)) for a, c in zip(_channels(mean), _channels(corner))])


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner)):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


#: left, top, top right, top left
MODES = (
    lambda a, t, r, c: BLACK,
    lambda a, t, r, c: a,
    lambda a, t, r, c: t,
    lambda a, t, r, c: r,
    lambda a, t, r, c: c,
    lambda a, t, r, c: _mean(_mean(a, r), t),
    lambda a, t, r, c: _mean(a, c),
    lambda a, t, r, c: _mean(a, t),
    lambda a, t, r, c: _mean(c, t),
    lambda a, t, r, c: _mean(t, r),
    lambda a, t, r, c: _mean(_mean(a, c), _mean(t, r)),
    lambda a, t, r, c: _select(a, t, c),
    lambda a, t, r, c: _full(a, t, c),
    lambda a, t, r, c: _half(_mean(a, t), c),
)


def _added(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sums(rest: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums of channels along the first axis, from ``first`` on."""
    return np.cumsum(rest, axis=0, dtype=np.uint8) + first


def undo_predictor(pixels: np.ndarray, width: int, height: int, size: int, modes: list[int]) -> np.ndarray:
    """Blocks that predict from nothing at once, then row by row; in a row what needs no left neighbour at once too."""
    across = -(-width >> size)
    mode = np.array(modes, np.int64) >> 8 & 15
    rest = np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(height, width, 4)
    black = np.array([0, 0, 0, 255], np.uint8)
    out = rest + black
    out[0] = _sums(rest[0], black)
    out[1:, 0] = _sums(rest[1:, 0], out[0, 0])
    if not (mode % 14).any():
        return out.reshape(-1, 4).view("<u4").ravel()
    mode = mode.reshape(-1, across)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        for k, m in enumerate(mode[y >> size].tolist()):
            low, high = max(1, k << size), min(width, k + 1 << size)
            if low >= high or m in (0, 14, 15):
                continue
            own, top, corner = rest[y, low:high], above[low:high], above[low - 1 : high - 1]
            if m == 1:
                row[low:high] = _sums(own, row[low - 1])
            elif m == 2:
                row[low:high] = own + top
            elif m == 4:
                row[low:high] = own + corner
            else:
                # the right neighbour of a row's last pixel above is the row's own first pixel
                line = out.reshape(-1, 4).view("<u4").ravel()
                at = y * width + low
                left, tops = int(line[at - 1]), line[at - width - 1 : at - width + high - low + 1].tolist()
                coded, guess, done = own.view("<u4").ravel().tolist(), MODES[m], []
                for i, c in enumerate(coded):
                    left = _added(c, guess(left, tops[i + 1], tops[i + 2], tops[i]))
                    done.append(left)
                row[low:high] = np.array(done, "<u4").view(np.uint8).reshape(-1, 4)
    return out.reshape(-1, 4).view("<u4").ravel()


def _signed(x):
    return (x ^ 128) - 128


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, size: int, elements: list[int]) -> np.ndarray:
    across = -(-width >> size)
    if not any(e & 0xFFFFFF for e in elements):
        return pixels
    i = np.arange(width * height)
    e = np.array(elements, np.int64)[(i // width >> size) * across + (i % width >> size)]
    p = pixels.astype(np.int64)
    green = _signed(p >> 8 & 255)
    red = (p >> 16) + (_signed(e & 255) * green >> 5) & 255
    blue = p + (_signed(e >> 8 & 255) * green >> 5) + (_signed(e >> 16 & 255) * _signed(red) >> 5) & 255
    return (p & 0xFF00FF00) | red << 16 | blue


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int64)
    green = p >> 8 & 255
    return (p & 0xFF00FF00) | ((p >> 16) + green & 255) << 16 | (p + green & 255)


def _bundle(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, colours: list[int]) -> np.ndarray:
    pack = _bundle(len(colours))
    index = pixels.astype(np.int64) >> 8 & 255
    if pack:
        each = 8 >> pack
        index = (index.reshape(height, -1)[:, :, None] >> (np.arange(1 << pack) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width].ravel()
    table = np.zeros(256, np.int64)
    table[: len(colours)] = colours
    return table[index]


def _payload(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise Corrupt("no lossless image in the file")


#: palettes read before, as (bits, their number, colours): many files have one in common
_seen: dict[int, list[tuple[int, int, list[int]]]] = {}


def _read_palette(bits: Bits, n: int) -> list[int]:
    known = _seen.setdefault(n, [])
    for value, size, colours in known:
        if bits.at + size <= bits.size and bits.value >> bits.at & ((1 << size) - 1) == value:
            bits.at += size
            return colours
    start = bits.at
    colours = _read_pixels(bits, n, 1, False)
    for i in range(1, n):
        colours[i] = _added(colours[i], colours[i - 1])
    if len(known) < 8:
        size = bits.at - start
        known.append((bits.value >> start & ((1 << size) - 1), size, colours))
    return colours


class _Head:
    """Everything before the main image's entropy-coded data."""

    def __init__(self, data: bytes):
        self.body = _payload(data)
        self.bits = bits = Bits(self.body)
        if bits.read(8) != SIGNATURE:
            raise Corrupt("no lossless signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        self.alpha = bits.read(1)
        if bits.read(3):
            raise Corrupt("unknown version")
        self.transforms, self.coded, seen = [], self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise Corrupt("a transform comes twice")
            seen.add(kind)
            if kind == PALETTE:
                n = bits.read(8) + 1
                colours = _read_palette(bits, n)
                self.transforms.append((kind, self.coded, colours))
                self.coded = -(-self.coded >> _bundle(n))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, self.coded, None))
            else:
                size = bits.read(3) + 2
                blocks = _read_pixels(bits, -(-self.coded >> size), -(-self.height >> size), False)
                self.transforms.append((kind, self.coded, (size, blocks)))

    def finish(self, pixels) -> np.ndarray:
        for kind, width, data in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = undo_predictor(np.asarray(pixels, np.int64), width, self.height, *data)
            elif kind == CROSS_COLOUR:
                pixels = undo_cross_colour(np.asarray(pixels, np.int64), width, self.height, *data)
            elif kind == SUBTRACT_GREEN:
                pixels = undo_subtract_green(np.asarray(pixels, np.int64))
            else:
                pixels = undo_palette(np.asarray(pixels, np.int64), width, self.height, data)
        return np.asarray(pixels, np.int64).astype(np.uint32).reshape(self.height, self.width)


def read(data: bytes) -> np.ndarray:
    """The image's ARGB values, (height, width) uint32."""
    head = _Head(data)
    return head.finish(_read_pixels(head.bits, head.coded, head.height, True))


def read_many(files: list[bytes]) -> list[np.ndarray]:
    """As ``read`` for each file; those without meta codes and with no long codes are decoded in step."""
    out: list[np.ndarray | None] = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        head = _Head(data)
        start = head.bits.at
        cache = head.bits.read(4) if head.bits.read(1) else 0
        plain = cache <= 11 and not head.bits.read(1)
        if plain:
            codes = _read_codes(head.bits, cache)
            plain = max(c.bits for c in codes) <= LONGEST_CODE
        if plain:
            lanes.append((head.coded * head.height, i, head, codes, cache))
        else:
            head.bits.at, head.bits.base = start, -1
            out[i] = head.finish(_read_pixels(head.bits, head.coded, head.height, True))
    lanes.sort(key=lambda x: -x[0])
    for low in range(0, len(lanes), LANES):
        for i, pixels in _in_step(lanes[low : low + LANES]):
            out[i] = pixels
    return out


def _read_codes(bits: Bits, cache: int) -> list[Code]:
    """The five codes; blue's is often the same as red's."""
    green = read_code(bits, GREENS + LENGTHS + (1 << cache if cache else 0))
    start = bits.at
    red = read_code(bits, 256)
    n = bits.at - start
    if n < 1000 and bits.at + n <= bits.size and bits.value >> start & (1 << n) - 1 == bits.value >> bits.at & (1 << n) - 1:
        bits.at += n
        blue = red
    else:
        blue = read_code(bits, 256)
    return [green, red, blue, read_code(bits, 256), read_code(bits, DISTANCES)]


class _Tables:
    """One code of each lane."""

    def __init__(self, codes: list[Code]):
        width = max(c.bits for c in codes)
        table = np.empty((len(codes), 1 << width), np.uint16)
        for row, c in zip(table, codes):
            row[:] = np.tile(c.table, 1 << (width - c.bits))
        self.width, self.table, self.mask = width, table.ravel(), (1 << width) - 1

    def next(self, lane: np.ndarray, data: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The lanes' next symbols; ``pos`` moves on."""
        if not self.width:
            return (self.table[lane] >> 4).astype(np.int64)
        found = self.table[(lane << self.width) + (data[pos >> 3] >> (pos & 7) & self.mask)]
        pos += found & 15
        return (found >> 4).astype(np.int64)


def _spread_all(code: np.ndarray, data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``_spread`` for many; ``pos`` moves on."""
    extra = np.maximum(code - 2, 0) >> 1
    more = data[pos >> 3] >> (pos & 7) & ((1 << extra) - 1)
    pos += extra
    return np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + more + 1)


_NEAR_X, _NEAR_Y = (np.array(x) for x in zip(*NEAR))


def _in_step(lanes):
    """Each round takes one symbol of every file that isn't done; files come longest first, so those left are a prefix."""
    green, red, blue, alpha, far = (_Tables([codes[k] for *_, codes, _ in lanes]) for k in (0, 1, 2, 3, 4))
    bodies = [head.body for _, _, head, *_ in lanes]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    data = np.frombuffer(b"".join(bodies) + bytes(64), np.uint8).astype(np.int64)
    data = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    at = 8 * starts[:-1] + np.array([head.bits.at for _, _, head, *_ in lanes])
    ends = 8 * starts[1:]
    totals = np.array([t for t, *_ in lanes])
    widths = np.array([head.coded for _, _, head, *_ in lanes])
    first = np.concatenate([[0], np.cumsum(totals)])
    stop = first[1:]
    out = np.zeros(first[-1], np.int64)
    # the colour caches, one after the other
    bits = np.array([cache for *_, cache in lanes])
    sizes = np.where(bits > 0, 1 << bits, 0)
    base = np.cumsum(sizes) - sizes
    held, cached = np.zeros(int(sizes.sum()), np.int64), bits > 0
    done, live = first[:-1].copy(), np.arange(len(lanes))
    while len(live):
        pos = at[live]
        symbol = green.next(live, data, pos)
        where = done[live]
        to = where + 1
        value = symbol << 8
        k = np.flatnonzero(symbol < GREENS)
        if len(k):
            lane, p = live[k], pos[k]
            value[k] |= red.next(lane, data, p) << 16
            value[k] |= blue.next(lane, data, p)
            value[k] |= alpha.next(lane, data, p) << 24
            pos[k] = p
        if len(k) < len(live):
            k = np.flatnonzero(symbol >= GREENS + LENGTHS)
            value[k] = held[base[live[k]] + symbol[k] - (GREENS + LENGTHS)]
            k = np.flatnonzero((symbol >= GREENS) & (symbol < GREENS + LENGTHS))
            lane, p = live[k], pos[k]
            length = _spread_all(symbol[k] - GREENS, data, p)
            back = _spread_all(far.next(lane, data, p), data, p)
            near = np.minimum(back, len(NEAR)) - 1
            back = np.where(back > len(NEAR), back - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * widths[lane]))
            pos[k] = p
            to[k] += length - 1
            if (where[k] - back < first[lane]).any() or (to[k] > stop[lane]).any():
                raise Corrupt("a back-reference leaves the image")
            place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            target, source = np.repeat(where[k], length) + place, np.repeat(where[k] - back, length) + place % np.repeat(back, length)
            out[target] = out[source]
            value[k] = out[where[k]]
            own = np.repeat(lane, length)
            keep = cached[own]
            own, target = own[keep], target[keep]
            # of several pixels for one place the last stays
            held[base[own] + ((out[target] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits[own]))] = out[target]
        if (pos > ends[live]).any():
            raise Corrupt("the bit stream ends early")
        out[where] = value
        k = np.flatnonzero(cached[live] & (to == where + 1))
        own = live[k]
        held[base[own] + ((value[k] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits[own]))] = value[k]
        at[live], done[live] = pos, to
        open_ = to < stop[live]
        if not open_.all():
            live = live[open_]
    for k, (_, i, head, *_) in enumerate(lanes):
        yield i, head.finish(out[first[k] : stop[k]])


#: bits of the writer's longest code
MOST_BITS = 10


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits for the symbols that occur."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used]
    while True:
        order = weight.argsort(kind="stable")
        own = _depths(weight[order].tolist())
        if max(own) <= most:
            lengths[used[order]] = own
            return lengths
        weight = (weight + 1) // 2


def _depths(weight: list[int]) -> list[int]:
    """Depths in the Huffman tree of ascending weights: the two least of the leaves left and of the trees made are joined."""
    n, top = len(weight), sum(weight) + 1
    leaves, trees = [*weight, top, top], [top] * (n + 1)
    leaf_in, tree_in = [0] * n, [0] * n
    i = j = 0
    for new in range(n - 1):
        total = 0
        for _ in (0, 1):
            if trees[j] < leaves[i]:
                total += trees[j]
                tree_in[j] = new
                j += 1
            else:
                total += leaves[i]
                leaf_in[i] = new
                i += 1
        trees[new] = total
    depth = [0] * n
    for k in range(n - 3, -1, -1):
        depth[k] = depth[tree_in[k]] + 1
    return [depth[k] + 1 for k in leaf_in]


#: how the writer codes the lengths of a code: 3 bits for some, 4 for the others, runs of 0 joined
_OWN = [3 if k in (7, 8, 17) else 4 if k < 11 or k == 18 else 0 for k in range(19)]
_OWN_HEAD = "".join([f"{_OWN[s]:03b}" for s in reversed(CODE_ORDER)]) + f"{19 - 4:04b}0"
_OWN_PACKED = sum(_OWN[s] << 3 * i for i, s in enumerate(CODE_ORDER))
_RUN = re.compile(rb"\x00{11,138}|\x00{3,10}|[\x00-\xff]")


@lru_cache(1)
def _own_bits() -> dict[bytes, str]:
    """The bits, last one first, of each part that ``_RUN`` finds."""
    text = {s: f"{reverse(c, n):0{n}b}" for s, (n, c) in canonical(_OWN).items()}
    out = {bytes([k]): text[k] for k in range(11)}
    for n in range(3, 11):
        out[bytes(n)] = f"{n - 3:03b}" + text[17]
    for n in range(11, 139):
        out[bytes(n)] = f"{n - 11:07b}" + text[18]
    return out


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.at
        self.at += int(n)

    def one(self, symbol: int) -> None:
        """The code of a single symbol, which takes no bits."""
        self.put(0b101 | symbol << 3 if symbol > 1 else 0b001 | symbol << 3, 11 if symbol > 1 else 4)

    def two(self, low: int, high: int) -> None:
        """The code of two symbols below 256, of one bit each."""
        self.put(0b111 | low << 3 | high << 11, 19)

    def code(self, lengths) -> None:
        """A normal code: the lengths, at most ``MOST_BITS``, up to the last that isn't 0."""
        own = _RUN.findall(lengths.astype(np.uint8).tobytes().rstrip(b"\0"))
        known = _own_bits()
        own += [b"\0"] * (2 - len(own))
        text = "".join([known[x] for x in reversed(own)]) + f"{len(own) - 2:010b}" + "1001" + _OWN_HEAD
        self.put(int(text, 2), len(text))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, number of extra bits, extra bits) of a length or distance"""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), extra, value & ((1 << extra) - 1)


def write_bytes(payload: np.ndarray, width: int) -> bytes:
    """One image of ``width`` columns with a byte in the green channel of each pixel. ``payload`` is a positive multiple of
    ``width`` long."""
    channels = np.zeros((len(payload) // width, width, 3), np.uint8)
    channels[:, :, 1] = payload.reshape(-1, width)
    return write(channels)


#: ``write`` has one predictor mode and one set of cross-colour multipliers for each square of 1 << TILE pixels
TILE = 4
#: predictor modes that the writer tries: none, left, top, left or top
TRIED = (0, 1, 2, 11)
#: sizes of the colour cache that the writer tries, in bits
CACHES = (0, 7)
#: pixels that a back-reference copies at least
LEAST_COPY = 3
#: bits that a tile must gain for another choice than none
WORTH = 16
#: red and blue share a code if that takes at most so many times their bits
SHARED = 1.03
#: bytes that are written together
TOGETHER = 1 << 18
#: scrambles a key so that its upper bits tell as much as all
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
#: n * log2(n)
_LOGS = np.arange(1 << 15) * np.log2(np.maximum(np.arange(1 << 15), 1))


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits that the values counted in each row take under a code of their own."""
    return _LOGS[np.minimum(counts.sum(-1), len(_LOGS) - 1)] - _LOGS[np.minimum(counts, len(_LOGS) - 1)].sum(-1)


def _least(choices: np.ndarray, tile: np.ndarray, n: int) -> np.ndarray:
    """Each tile's choice whose values take the fewest bits; ``choices`` has the values of all of them, row by row."""
    key = choices + ((np.arange(len(choices)) * n)[:, None] + tile << 8)
    bits = _bits(np.bincount(key.ravel(), minlength=len(choices) * n << 8).reshape(len(choices), n, 256))
    bits[1:] += WORTH
    return bits.argmin(0)


def _guesses(p: np.ndarray) -> Iterator[np.ndarray]:
    """What each of ``TRIED`` predicts of the pixels below the first row and right of the first column."""
    left, top, corner = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    yield np.zeros_like(left)
    yield left
    yield top
    a, t, c = (x.astype(np.int16) for x in (left, top, corner))
    to_left, to_top = (x[:, :, 0] + x[:, :, 1] + x[:, :, 2] for x in (np.abs(t - c), np.abs(a - c)))
    yield np.where((to_left < to_top)[:, :, None], left, top)


def _predicted(p: np.ndarray, top: np.ndarray, tile: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's mode, the one that takes the fewest bits, and what its predictions leave of the rows ``p``; ``top`` marks
    the first row of each image."""
    rest = np.empty((len(TRIED), *p.shape), np.uint8)
    across, down = p[:, 1:] - p[:, :-1], p[1:, 0] - p[:-1, 0]
    for out, guess in zip(rest, _guesses(p)):
        out[1:, 1:] = p[1:, 1:] - guess
        out[1:, 0] = down
        out[top, 1:] = across[top]
        out[top, 0] = p[top, 0]
    best = _least(rest.reshape(len(TRIED), -1), np.repeat(tile, 3), n)
    return np.array(TRIED)[best], rest.reshape(len(TRIED), -1, 3)[best[tile], np.arange(len(tile))]


def _decorrelated(p: np.ndarray, tile: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's multipliers, 0 or 1 as the format's 32ths, and what they leave of the pixels ``p``, as ARGB without alpha."""
    red, green, blue = p.T
    reds, blues = np.stack([red, red - green]), np.stack([blue, blue - green, blue - red])
    r, b = _least(reds, tile, n), _least(blues, tile, n)
    at = np.arange(len(p))
    pixels = reds[r[tile], at].astype(np.uint64) << np.uint64(16) | green.astype(np.uint64) << np.uint64(8) | blues[b[tile], at]
    return np.where(r == 1, 32, 0) | np.where(b == 1, 32 << 8, 0) | np.where(b == 2, 32 << 16, 0), pixels


def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits of the keys in ascending order, and the place of each; equal ones by place. One sort of single numbers,
    so keys are cut to the bits that the places leave."""
    n = np.uint64(max(len(key) - 1, 1).bit_length())
    both = np.sort((key >> n << n) | np.arange(len(key), dtype=np.uint64))
    return both >> n, (both & (np.uint64(1) << n) - np.uint64(1)).astype(np.int64)


def _copies(p: np.ndarray, image: np.ndarray, first: list[int]) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the back-references: at each place the last one of its image that starts with the same
    pixels."""
    n = len(p) - LEAST_COPY + 1
    if n < 2:
        return []
    key = sum((p[k : n + k] * _WEIGHTS[k] for k in range(LEAST_COPY)), image[:n].astype(np.uint64) << np.uint64(40))
    key, order = _in_order(key * _SCRAMBLE)
    same = np.flatnonzero(key[1:] == key[:-1])
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    out, free = [], 0
    for i, j, k in zip(places.tolist(), before[places].tolist(), image[places].tolist()):
        if i < free or j < first[k]:
            continue
        most = min(LONGEST_COPY, first[k + 1] - i)
        own = p[i : i + most]
        # most copies are short
        other = (own[:16] != p[j : j + min(16, most)]).nonzero()[0]
        if not len(other):
            other = (own != p[j : j + most]).nonzero()[0]
        length = int(other[0]) if len(other) else most
        if length >= LEAST_COPY:
            out.append((i, length, i - j))
            free = i + length
    return out


def _cache_hits(p: np.ndarray, image: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in a colour cache of its image, and whether the cache has it there when it comes."""
    slot = ((p * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    n = max(len(p) - 1, 1).bit_length()
    key, order = _in_order((image << bits | slot).astype(np.uint64) << np.uint64(n))
    hit, pixel = np.zeros(len(p), bool), p[order]
    hit[order[1:]] = (key[1:] == key[:-1]) & (pixel[1:] == pixel[:-1])
    return slot, hit


@lru_cache(8)
def _near(width: int) -> dict[int, int]:
    """The least value for each distance that has one among the near ones."""
    return {_distance(v, width): v for v in range(len(NEAR), 0, -1)}


def _put_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for the counted symbols; gives every symbol's length and its bits."""
    size, code = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) < 2:
        w.one(int(used[0]) if len(used) else 0)
        return size, code
    if len(used) == 2 and used[1] < 256:
        w.two(*used.tolist())
        size[used], code[used[1]] = 1, 1
        return size, code
    size = code_lengths(counts)
    w.code(size)
    used = used[size[used].argsort(kind="stable")]
    most = int(size[used[-1]])
    share = 1 << (most - size[used])
    code[used] = reversals(most)[share.cumsum() - share]
    return size, code


def _put_pixels(writers: list[Writer], p: np.ndarray, image: np.ndarray, first: list[int], width: int) -> list[bytes]:
    """What each writer holds and then the pixels of its image: back-references, colour cache, literals."""
    n = len(writers)
    copies = _copies(p, image, first)
    alone, start = np.ones(len(p), bool), np.ones(len(p), bool)
    for i, length, _ in copies:
        alone[i : i + length] = False
        start[i + 1 : i + length] = False
    green, red, blue = ((p >> np.uint64(shift) & np.uint64(255)).astype(np.int64) for shift in (8, 16, 0))
    wide = GREENS + LENGTHS + (1 << max(CACHES))
    own = np.flatnonzero(alone)
    at = image[own]
    # each pixel's counters of its green, red and blue
    places = [at * wide + green[own], at * 256 + red[own], at * 256 + blue[own]]
    sizes = (wide, 256, 256)

    def counted(places):
        return [np.bincount(x, minlength=n * size).reshape(n, size) for x, size in zip(places, sizes)]

    base, costs, tries = counted(places), [], []
    for bits in CACHES:
        counts, slot, hit = base, None, None
        if bits:
            slot, hit = _cache_hits(p, image, bits)
            k = np.flatnonzero(hit[own])
            counts = [x - y for x, y in zip(base, counted([x[k] for x in places]))]
            counts[0] += np.bincount(at[k] * wide + GREENS + LENGTHS + slot[own[k]], minlength=n * wide).reshape(n, wide)
        # a symbol's length is written in some four bits
        costs.append(sum(_bits(c) + 4 * np.count_nonzero(c, axis=1) for c in counts))
        tries.append((slot, hit, counts))
    best = np.argmin(costs, axis=0)
    symbol, literal = green.copy(), alone.copy()
    for j, (slot, hit, _) in enumerate(tries):
        if hit is not None:
            k = np.flatnonzero(hit & (best == j)[image])
            symbol[k], literal[k] = GREENS + LENGTHS + slot[k], False
    counts = [np.stack([x[2][k] for x in tries])[best, np.arange(n)] for k in range(3)]
    far, near, parts = np.zeros((n, DISTANCES), np.int64), _near(width), []
    if copies:
        parts = np.array([(i, *_prefix(length), *_prefix(near.get(back, back + len(NEAR)))) for i, length, back in copies]).T
        symbol[parts[0]] = GREENS + parts[1]
        np.add.at(counts[0], (image[parts[0]], symbol[parts[0]]), 1)
        np.add.at(far, (image[parts[0]], parts[4]), 1)
    sizes, codes = ([np.zeros(c.shape, np.int64) for c in (*counts, far)] for _ in range(2))
    both = counts[1] + counts[2]
    alike = _bits(both) <= SHARED * (_bits(counts[1]) + _bits(counts[2]))
    counts[1][alike] = counts[2][alike] = both[alike]
    for k, w in enumerate(writers):
        bits = CACHES[best[k]]
        w.put(1 | bits << 1 if bits else 0, 5 if bits else 1)
        w.put(0, 1)  # no meta codes
        size = GREENS + LENGTHS + (1 << bits if bits else 0)
        for c, (of, length, code) in enumerate(zip((*counts, far), sizes, codes)):
            if c == 3:
                w.one(0)  # alpha: opaque, as the predictor foretells
            if c == 2 and alike[k]:
                w.put(w.value >> begun, w.at - begun)
                length[k], code[k] = sizes[1][k], codes[1][k]
                continue
            begun, own = w.at, of[k, :size] if not c else of[k]
            length[k, : len(own)], code[k, : len(own)] = _put_code(w, own)
    # one row a token: (value, bits) of the symbol with red or a length's extra bits, and of blue or the distance with its extra bits
    tables = [(code << 4 | size).ravel() for size, code in zip(sizes, codes)]
    tokens = np.flatnonzero(start)
    of, lit = image[tokens], np.flatnonzero(literal[tokens])
    size, code = np.zeros((len(tokens), 2), np.int64), np.zeros((len(tokens), 2), np.int64)
    own = tables[0][of * wide + symbol[tokens]]
    size[:, 0], code[:, 0] = own & 15, own >> 4
    own, at = tokens[lit], of[lit] * 256
    first_, second = tables[1][at + red[own]], tables[2][at + blue[own]]
    code[lit, 0] |= first_ >> 4 << size[lit, 0]
    size[lit, 0] += first_ & 15
    size[lit, 1], code[lit, 1] = second & 15, second >> 4
    if copies:
        k = np.searchsorted(tokens, parts[0])
        code[k, 0] |= parts[3] << size[k, 0]
        size[k, 0] += parts[2]
        own = tables[3][of[k] * DISTANCES + parts[4]]
        size[k, 1], code[k, 1] = (own & 15) + parts[5], own >> 4 | parts[6] << (own & 15)
    return _packed(writers, size, code, of)


def _packed(writers: list[Writer], size: np.ndarray, code: np.ndarray, image: np.ndarray) -> list[bytes]:
    """The bits that each writer holds and after them the codes of its image's tokens, each in two parts of at
    most 32 bits."""
    each = np.bincount(image, size.sum(1), len(writers)).astype(np.int64)
    head = np.array([w.at for w in writers])
    words_of = (head + each + 31 >> 5) + 1
    base = np.cumsum(words_of) - words_of
    skip = 32 * base + head - (np.cumsum(each) - each)
    size, code = size.ravel(), code.ravel()
    at = np.cumsum(size) - size + np.repeat(skip[image], 2)
    value = code.astype(np.uint64) << (at & 31).astype(np.uint64)
    word, n = at >> 5, int(words_of.sum()) + 1
    low = np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    low[1:] += np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)[:-1]
    words = low.astype(np.uint64).astype("<u4")
    out = []
    for w, b, bits in zip(writers, base.tolist(), (head + each).tolist()):
        own = np.frombuffer(w.value.to_bytes(4 * (-(-w.at // 32)), "little"), "<u4")
        words[b : b + len(own)] |= own
        out.append(words[b : b + (-(-bits // 32))].tobytes()[: -(-bits // 8)])
    return out


def _put_blocks(w: Writer, values: np.ndarray) -> None:
    """The image of a transform's blocks, of few pixels: red, green and blue as they are."""
    w.put(0, 1)
    if not values.any():
        for _ in range(5):
            w.one(0)
        return
    channels = [values >> shift & 255 for shift in (8, 16, 0)]
    codes = [_put_code(w, np.bincount(c, minlength=256)) for c in channels]
    w.one(0)
    w.one(0)
    for row in zip(*(c.tolist() for c in channels)):
        for (size, code), v in zip(codes, row):
            w.put(int(code[v]), int(size[v]))


def write(channels: np.ndarray) -> bytes:
    """One opaque image of (height, width, 3) bytes, red, green and blue."""
    return write_many([channels])[0]


def write_many(images: list[np.ndarray]) -> list[bytes]:
    """Opaque images of one width, each (height, width, 3) bytes: predictor, cross-colour, back-references, colour cache and
    prefix codes. Modes, multipliers and the size of the cache are those that take the fewest bits."""
    out, low = [], 0
    while low < len(images):
        high, held = low, 0
        while high < len(images) and (high == low or held < TOGETHER):
            held += images[high].size
            high += 1
        out += _write_some(images[low:high])
        low = high
    return out


def _write_some(images: list[np.ndarray]) -> list[bytes]:
    rows, width = np.concatenate(images), images[0].shape[1]
    heights = np.array([len(x) for x in images])
    start = np.cumsum(heights) - heights
    image = np.repeat(np.arange(len(images)), heights)
    y = np.arange(len(rows)) - start[image]
    across = -(-width >> TILE)
    n = across * -(-heights >> TILE)
    first = np.cumsum(n) - n
    tile = ((first[image] + (y >> TILE) * across)[:, None] + (np.arange(width) >> TILE)).ravel()
    modes, rest = _predicted(rows, y == 0, tile, int(n.sum()))
    multipliers, pixels = _decorrelated(rest, tile, int(n.sum()))
    writers = []
    for height, a, b in zip(heights.tolist(), first.tolist(), (first + n).tolist()):
        w = Writer()
        w.put(SIGNATURE | width - 1 << 8 | height - 1 << 22, 40)
        for kind, blocks in ((PREDICTOR, modes[a:b] << 8), (CROSS_COLOUR, multipliers[a:b])):
            w.put(1 | kind << 1 | TILE - 2 << 3, 6)
            _put_blocks(w, blocks)
        w.put(0, 1)
        writers.append(w)
    bodies = _put_pixels(writers, pixels, np.repeat(image, width), [*(start * width).tolist(), len(pixels)], width)
    chunks = [b"VP8L" + len(x).to_bytes(4, "little") + x + bytes(len(x) & 1) for x in bodies]
    return [b"RIFF" + (4 + len(x)).to_bytes(4, "little") + b"WEBP" + x for x in chunks]
