"""Lossless WebP (VP8L): a decoder into pixel arrays, and an encoder with prefix codes, back-references, colour cache and transforms.

Pixels are unsigned 32-bit ARGB. Images that have one group of codes are parsed by whole
arrays: a table lookup at every bit gives the pixel that would start there and where it would end, and a walk
over those ends picks the pixels that do; it stops at back-references alone. Others are read symbol by symbol.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import groupby

import numpy as np

# Fixed values of the format: the order in which lengths of the code-length code are written.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# Fixed values of the format: (columns left, rows up) of distance codes 1 to 120.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
NEAR_LEFT_UP = np.array(NEAR)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)


class WebpError(ValueError):
    """Bytes that aren't a lossless WebP image."""


class Bits:
    """A reader of little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.end:
            raise WebpError("the image data ends too early")
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 5], "little")
        out = (word >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def peek15(self) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7)) & 0x7FFF


_K = np.arange(1 << 15)
#: Each number of 15 bits read from its other end.
TURNED = sum(((_K >> k) & 1) << (14 - k) for k in range(15)).astype(np.int64)


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the lengths, first bit lowest."""
    used = np.flatnonzero(lengths)
    own = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (15 - lengths[own])
    codes = np.zeros(len(lengths), np.int64)
    codes[own] = TURNED[(np.cumsum(share) - share) & 0x7FFF]
    return codes


class PrefixCode:
    """Lookup tables over the next ``bits`` bits: symbol, and bits that it takes (0 for a code of one symbol)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise WebpError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, np.array([used[0]], np.int32), np.zeros(1, np.int32)
        else:
            self.bits = int(lengths.max())
            own = used[np.argsort(lengths[used], kind="stable")]
            share = 1 << (self.bits - lengths[own])
            if int(share.sum()) != 1 << self.bits:
                raise WebpError("a prefix code that isn't complete")
            # codes in order fill the table from its start when bits are read from the other end
            order = TURNED[: 1 << self.bits] >> (15 - self.bits)
            self.symbol = np.repeat(own, share).astype(np.int32)[order]
            self.length = np.repeat(lengths[own], share).astype(np.int32)[order]
        self.mask = (1 << self.bits) - 1
        self.symbols, self.lengths = memoryview(self.symbol), memoryview(self.length)

    def read(self, bits: Bits) -> int:
        k = bits.peek15() & self.mask
        bits.at += self.lengths[k]
        if bits.at > bits.end:
            raise WebpError("the image data ends too early")
        return self.symbols[k]


@lru_cache(maxsize=1024)
def _one_symbol(symbol: int, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    lengths[symbol] = 1
    return PrefixCode(lengths)


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        chosen = [first, bits.read(8)] if two else [first]
        if max(chosen) >= alphabet:
            raise WebpError("a symbol outside its alphabet")
        if not two:
            return _one_symbol(first, alphabet)
        lengths[chosen] = 1
        return PrefixCode(lengths)
    small = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        small[LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # what is left of them takes 14 bits a symbol at most
    first = bits.at >> 3
    word = int.from_bytes(bits.data[first : first + 2 * min(left, alphabet) + 4], "little") >> (bits.at & 7)
    out: list[int] = []
    before, used, mask, symbols, taken = 8, 0, code.mask, code.symbols, code.lengths
    while len(out) < alphabet and left > 0:
        left -= 1
        k = (word >> used) & mask
        s = symbols[k]
        used += taken[k]
        if s < 16:
            out.append(s)
            before = s or before
        else:
            size, least = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
            out += [before if s == 16 else 0] * (least + ((word >> used) & ((1 << size) - 1)))
            used += size
    bits.at += used
    if bits.at > bits.end:
        raise WebpError("the image data ends too early")
    if len(out) > alphabet:
        raise WebpError("code lengths run over the alphabet")
    lengths[: len(out)] = out
    return PrefixCode(lengths)


def read_group(bits: Bits, cache_bits: int) -> list[PrefixCode]:
    group = []
    for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40):
        head = bits.peek15()
        if head & 7 == 0b101 and bits.at + 11 <= bits.end and head >> 3 & 255 < n:
            # one symbol of 8 bits, as most codes are
            bits.at += 11
            group.append(_one_symbol(head >> 3 & 255, n))
        else:
            group.append(read_code(bits, n))
    return group


def prefix_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    left, up = NEAR[code - 1]
    return max(1, left + up * width)


def _copy(out: np.ndarray, at: int, back: int, n: int) -> None:
    if back > at or at + n > len(out):
        raise WebpError("a back-reference leaves the image")
    if back >= n:
        out[at : at + n] = out[at - back : at - back + n]
    else:
        out[at : at + n] = np.resize(out[at - back : at], n)


def cache_slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _fill_cached(pixels: np.ndarray, held: np.ndarray, slot: np.ndarray, cache: np.ndarray, cache_bits: int) -> None:
    """Put in the cached pixels of a run without copies: each is the last literal of its slot, or what ``cache`` had there before the run."""
    slot = np.where(held, slot, cache_slots(pixels, cache_bits))
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    slot, held, inside = slot[order], held[order], pixels[order]
    place = np.arange(len(order))
    literal = np.maximum.accumulate(np.where(held, -1, place))
    # a literal of another slot lies before this one's rows
    pixels[order] = np.where((literal >= 0) & (slot[literal] == slot), inside[literal], cache[slot])


def pixels_by_arrays(bits: Bits, group: list[PrefixCode], width: int, total: int, cache_bits: int = 0) -> np.ndarray:
    """Pixels of an image with one group of codes."""
    start = bits.at >> 3
    padded = np.concatenate([np.frombuffer(bits.data, np.uint8)[start:], np.zeros(10, np.uint8)]).astype(np.uint32)
    word = padded[:-2] | (padded[1:-1] << 8) | (padded[2:] << 16)
    ahead = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    last = len(ahead) - 1
    green = group[0]
    key = ahead & np.uint32(green.mask)
    place = np.arange(len(ahead), dtype=np.int32)
    copies = (green.symbol > 255) & (green.symbol < 280)
    starts = [place] * 3
    # below 0 where a back-reference starts; a cached pixel has no other channels
    if not any(code.bits for code in group[1:4]):
        place = place + np.where(copies, np.int32(-(1 << 30)), green.length).take(key, mode="clip")
    else:
        place += green.length.take(key, mode="clip")
        starts, after_first = [], place.copy() if cache_bits else place
        for code in group[1:4]:
            starts.append(place)
            if code.bits:
                np.minimum(place, last, out=place)
                place = place + code.length[ahead[place] & np.uint32(code.mask)]
        if cache_bits:
            place = np.where((green.symbol < 280).take(key, mode="clip"), place, after_first)
        place[copies.take(key, mode="clip")] = -1
    np.minimum(place, last, out=place)
    place[last] = -1
    follow = memoryview(place)
    at, out = bits.at - 8 * start, np.zeros(total, np.uint32)
    found, where, stops = [], [], []
    n, span, add = 0, 0, found.append
    first = 0
    while n < total:
        before = len(found)
        for _ in range(total - n):
            following = follow[at]
            if following < 0:
                break
            add(at)
            at = following
        n += len(found) - before
        if n < total:
            s = int(green.symbol[key[at]])
            if at == last or not 256 <= s < 280:
                raise WebpError("the image data ends too early")
            where.append((first, n))
            bits.at = 8 * start + at + int(green.length[key[at]])
            size = prefix_value(bits, s - 256)
            stops.append((n, distance(prefix_value(bits, group[4].read(bits)), width), size))
            n += size
            first = n
            at = bits.at - 8 * start
    bits.at = 8 * start + at
    if bits.at > bits.end or n != total:
        raise WebpError("the image data ends too early")
    where.append((first, n))
    found_at = np.array(found, np.int64)
    symbol = green.symbol[key[found_at]]
    value = symbol.astype(np.uint32) << np.uint32(8)
    for code, begin, shift in zip(group[1:4], starts, (16, 0, 24), strict=True):
        if code.bits:
            value |= code.symbol[ahead[np.minimum(begin[found_at], last)] & np.uint32(code.mask)].astype(np.uint32) << np.uint32(shift)
        else:
            value |= np.uint32(int(code.symbol[0]) << shift)
    held = symbol >= 280
    cache, cached = np.zeros(1 << cache_bits, np.uint32), 0
    for (a, b), stop in zip(where, [*stops, None], strict=True):
        out[a:b] = value[span : span + b - a]
        if cache_bits and held[span : span + b - a].any():
            # pixels enter the cache in order, all that came before; of equal slots the last one stays
            cache[cache_slots(out[cached:a], cache_bits)] = out[cached:a]
            _fill_cached(out[a:b], held[span : span + b - a], symbol[span : span + b - a] - 280, cache, cache_bits)
            cached = a
        span += b - a
        if stop:
            _copy(out, *stop)
    return out


def pixels_by_symbols(bits: Bits, groups: list[list[PrefixCode]], choice: np.ndarray | None, choice_bits: int, width: int, height: int, cache_bits: int) -> np.ndarray:
    """Pixels of any image; ``choice`` gives the group of codes of each tile."""
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    cached = 0
    at = 0

    def fill(upto: int) -> None:
        # pixels enter the cache in order
        nonlocal cached
        for x in out[cached:upto].tolist():
            cache[((x * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)] = x
        cached = upto

    while at < total:
        group = groups[0] if choice is None else groups[choice[(at // width) >> choice_bits, (at % width) >> choice_bits]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = (alpha << 24) | (red << 16) | (s << 8) | blue
            at += 1
        elif s < 280:
            n = prefix_value(bits, s - 256)
            _copy(out, at, distance(prefix_value(bits, group[4].read(bits)), width), n)
            at += n
        else:
            fill(at)
            out[at] = cache[s - 280]
            at += 1
    return out


#: Images of so few pixels are read symbol by symbol, since a table over the bits that follow would take longer.
FEW = 256


class Unread:
    """A main image whose codes are read and whose pixels follow."""

    def __init__(self, bits: Bits, group: list[PrefixCode], width: int, height: int, cache_bits: int):
        self.bits, self.group, self.width, self.height, self.cache_bits = bits, group, width, height, cache_bits


def read_image(bits: Bits, width: int, height: int, main: bool, later: bool = False) -> np.ndarray | Unread:
    """Pixels of an image; with ``later`` those that ``pixels_together`` reads aren't read yet."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("a colour cache too large")
    choice, choice_bits, count = None, 0, 1
    if main and bits.read(1):
        choice_bits = bits.read(3) + 2
        tiles = read_image(bits, -(-width >> choice_bits), -(-height >> choice_bits), False)
        choice = ((tiles >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        count = int(choice.max()) + 1
    groups = [read_group(bits, cache_bits) for _ in range(count)]
    if choice is None and not any(code.bits for code in groups[0][:4]) and groups[0][0].symbols[0] < 256:
        g, r, b, a = (code.symbols[0] for code in groups[0][:4])
        return np.full((height, width), a << 24 | r << 16 | g << 8 | b, np.uint32)
    if choice is None and width * height > FEW:
        if later and groups[0][0].bits and not any(code.bits for code in groups[0][1:4]):
            return Unread(bits, groups[0], width, height, cache_bits)
        return pixels_by_arrays(bits, groups[0], width, width * height, cache_bits).reshape(height, width)
    return pixels_by_symbols(bits, groups, choice, choice_bits, width, height, cache_bits).reshape(height, width)


#: Steps that are walked side by side before images which have ended are left out, and the fewest images for it.
STRIDE, ABREAST = 64, 8


def _ends_of_copies(at: np.ndarray, word: np.ndarray, image: Unread, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where copies that start at the bits ``at`` end, their pixels and distances."""

    def ahead(at: np.ndarray) -> np.ndarray:
        return word[np.minimum(at >> 3, len(word) - 1)].astype(np.int64) >> (at & 7)

    def number(at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        low = ahead(at) & ((1 << extra) - 1)
        return at + extra, np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + low) + 1

    at, size = number(at + (entry & 15), (entry >> 4) - 256)
    far = image.group[4]
    key = ahead(at) & far.mask
    at, code = number(at + far.length[key], far.symbol[key].astype(np.int64))
    near = np.maximum(NEAR_LEFT_UP @ np.array([1, image.width]), 1)
    return at, size, np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])


def _walked(follow: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places met from each of the ``starts`` on, up to its end and some beyond: a row per image after the other, and their numbers."""
    alive, at = np.arange(len(starts)), starts.astype(np.int32)
    walks: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.zeros(len(starts), np.int64)
    single: dict[int, np.ndarray] = {}
    while len(alive) >= ABREAST:
        met = np.empty((STRIDE, len(alive)), np.int32)
        met[0] = at
        for k in range(1, STRIDE):
            follow.take(met[k - 1], out=met[k], mode="clip")
        at = follow.take(met[-1], mode="clip")
        walks.append((alive, met))
        rows[alive] += 1
        on = at < ends[alive]
        alive, at = alive[on], at[on]
    numbers = memoryview(follow)
    for k, place in zip(alive.tolist(), at.tolist(), strict=True):
        met, end = [], int(ends[k])
        add = met.append
        while place < end:
            add(place)
            place = numbers[place]
        met += [place] * (-len(met) % STRIDE)
        single[k] = np.array(met, np.int32)
    row_of = np.concatenate([[0], np.cumsum(rows + [len(single.get(k, ())) // STRIDE for k in range(len(starts))])])
    out = np.empty((row_of[-1], STRIDE), np.int32)
    for number, (which, met) in enumerate(walks):
        out[row_of[which] + number] = met.T
    for k, met in single.items():
        out[row_of[k] + rows[k] : row_of[k + 1]] = met.reshape(-1, STRIDE)
    return out.ravel(), np.diff(row_of) * STRIDE


def pixels_together(images: list[Unread]) -> list[np.ndarray]:
    """Pixels of images in which green alone has a code of several symbols.

    A table lookup at every bit gives where the pixel or copy that would start there would end; all images are walked side by side."""
    begins, pieces, at = [], [], 0
    for image in images:
        first = image.bits.at >> 3
        begins.append((at * 8 + (image.bits.at & 7), (at + len(image.bits.data) - first) * 8))
        pieces += [image.bits.data[first:], b"\0" * 8]
        at += len(image.bits.data) - first + 8
    starts, ends = np.array(begins, np.int64).T
    data = np.frombuffer(b"".join([*pieces, b"\0" * 3]), np.uint8).astype(np.uint32)
    word = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    many = 8 * len(word)
    # symbols and 4 bits fit 16 bits but in the largest cache
    kind = np.int16 if max(image.cache_bits for image in images) < 11 else np.int32
    entry, follow = np.empty(many, kind), np.arange(many, dtype=np.int32)
    copy_at, copy_size, copy_back = [], [], []
    cuts = [*(starts & ~7).tolist(), many]
    for image, a, b in zip(images, cuts[:-1], cuts[1:], strict=True):
        green = image.group[0]
        # symbol and bits in one number, which is below 0 for copies
        copies = (green.symbol > 255) & (green.symbol < 280)
        table = (green.symbol << 4 | green.length).astype(kind)
        for at in range(a, b, 1 << 17):
            upto = min(at + (1 << 17), b)
            here, part = word[at >> 3 : upto >> 3], entry[at:upto]
            key = np.empty((len(here), 8), np.int64)
            for k in range(8):
                np.bitwise_and(here >> np.uint32(k), np.uint32(green.mask), out=key[:, k])
            np.where(copies, ~table, table).take(key.ravel(), out=part, mode="clip")
            if copies.any():
                some = np.flatnonzero(part < 0)
                part[some] = ~part[some]
                follow[at:upto] += part & 15
                end, size, back = _ends_of_copies(at + some, word, image, part[some].astype(np.int64))
                follow[at:upto][some] = np.minimum(end, many - 1)
                copy_at.append(at + some), copy_size.append(size), copy_back.append(back)
            else:
                follow[at:upto] += part & 15
    np.minimum(follow[-64:], many - 1, out=follow[-64:])
    met, steps = _walked(follow, starts, ends)
    symbol = entry.take(met, mode="clip") >> 4
    size = np.ones(len(met), np.int64)
    is_copy = (symbol > 255) & (symbol < 280)
    which = np.flatnonzero(is_copy)
    if len(which):
        known, sizes, backs = (np.concatenate(x) for x in (copy_at, copy_size, copy_back))
        row = np.searchsorted(known, met[which])
        size[which], back = sizes[row], backs[row]
    totals = np.array([image.width * image.height for image in images])
    first_step, first_pixel = np.cumsum(steps) - steps, np.cumsum(totals) - totals
    place = np.cumsum(size) - size
    place -= np.repeat(place[first_step], steps)
    of = np.repeat(np.arange(len(images), dtype=np.int32), steps)
    inside = place < totals[of]
    # an image's last symbol ends where its pixels do and before its data's end
    last = first_step + np.add.reduceat(inside, first_step, dtype=np.int64) - 1
    if (place[last] + size[last] != totals).any() or (follow[met[last]] > ends).any():
        raise WebpError("the image data ends too early")
    place += first_pixel[of]
    n = int(totals.sum())
    constant = np.array([[code.symbols[0] for code in image.group[1:4]] for image in images], np.uint32) @ np.array([1 << 16, 1, 1 << 24], np.uint32)
    cache_sizes = np.array([1 << image.cache_bits for image in images])
    out, slot, held = np.zeros(n, np.uint32), np.zeros(n, np.int32), np.zeros(n, bool)
    literal = np.flatnonzero(inside & (symbol < 256))
    out[place[literal]] = symbol[literal].astype(np.uint32) << np.uint32(8) | constant[of[literal]]
    cached = np.flatnonzero(inside & (symbol >= 280))
    slot[place[cached]], held[place[cached]] = symbol[cached] - 280, True
    if len(cached):
        # a literal's slot; a cached pixel has its own
        shift = np.repeat((32 - np.array([image.cache_bits for image in images])).astype(np.uint64), totals)
        slot = np.where(held, slot, ((out * np.uint32(CACHE_FACTOR)).astype(np.uint64) >> shift).astype(np.int32))
        slot += np.repeat((np.cumsum(cache_sizes) - cache_sizes).astype(np.int32), totals)
    source = np.arange(n + 1, dtype=np.int32)
    if len(which):
        keep = inside[which]
        which, back = which[keep], back[keep]
        rows = zip(place[which].tolist(), first_pixel[of[which]].tolist(), back.tolist(), size[which].tolist(), (first_pixel + totals)[of[which]].tolist(), strict=True)
        for at, first, far, many, end in rows:
            _copy(source[first:end], at - first, far, many)
        # a copied pixel has its source's slot, and is in the cache from there on
        slot, held = slot[source[:-1]], held & (source[:-1] == np.arange(n))
    if len(cached):
        _point_at_slots(source, held, slot)
    moved = np.flatnonzero(source[:-1] != np.arange(n))
    at = source[moved]
    while ((further := source[at]) != at).any():
        source[moved] = at = further
    out[moved] = np.append(out, np.uint32(0))[at]
    return [out[a : a + image.width * image.height].reshape(image.height, image.width) for a, image in zip(first_pixel.tolist(), images, strict=True)]


def _point_at_slots(source: np.ndarray, held: np.ndarray, slot: np.ndarray) -> None:
    """Each cached pixel's source is the last one of its slot that isn't itself cached, or the place after all pixels (0) before the first."""
    order = np.argsort(slot.astype(np.uint16) if int(slot.max()) < 1 << 16 else slot, kind="stable").astype(np.int32)
    slot, held = slot[order], held[order]
    literal = np.maximum.accumulate(np.where(held, np.int32(-1), np.arange(len(order), dtype=np.int32)))
    rows = np.flatnonzero(held)
    literal = literal[rows]
    source[order[rows]] = np.where((literal >= 0) & (slot[literal] == slot[rows]), order[literal], len(order))


# --- inverse transforms ----------------------------------------------------------------------------------------


def channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha as a last axis of bytes."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def predict(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of pixels (rows of signed channels), each by its mode, from their left, upper, upper right and upper left neighbours."""
    half = lambda a, b: (a + b) >> 1
    mean = half(left, top)
    ways = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: right,
        4: lambda: corner,
        5: lambda: half(half(left, right), top),
        6: lambda: half(left, corner),
        7: lambda: mean,
        8: lambda: half(corner, top),
        9: lambda: half(top, right),
        10: lambda: half(half(left, corner), half(top, right)),
        # whichever neighbour lies nearer to left + top - corner
        11: lambda: np.where((np.abs(top - corner).sum(1) < np.abs(left - corner).sum(1))[:, None], left, top),
        12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255),
    }
    out = np.tile(np.array([0, 0, 0, 255]), (len(mode), 1))
    for m in np.unique(mode).tolist():
        if m in ways:
            rows = mode == m
            out[rows] = ways[m]()[rows]
    return out


def _modes(modes: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    """Each pixel's mode; the first row and column have their own."""
    each = ((modes >> np.uint32(8)) & np.uint32(15)).astype(np.int64)[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    each[0], each[:, 0] = 1, 2
    each[0, 0] = 0
    return each


#: All but green: where only green differs from its predictions, red and blue stay 0 and alpha 255, whatever the modes.
NOT_GREEN = 0xFFFF00FF


def green_predictions(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions of one channel by all 14 modes (a row each), where no other channel differs between neighbours."""
    out = np.empty((14, len(left)), np.int16)
    out[0], out[1], out[2], out[3], out[4] = 0, left, top, right, corner
    out[5] = (((left + right) >> 1) + top) >> 1
    out[6] = (left + corner) >> 1
    out[7] = (left + top) >> 1
    out[8] = (corner + top) >> 1
    out[9] = (top + right) >> 1
    out[10] = (out[6] + out[9]) >> 1
    out[11] = np.where(np.abs(top - corner) < np.abs(left - corner), left, top)
    out[12] = left + top - corner
    step = out[7] - corner
    out[13] = out[7] + ((step + (step < 0)) >> 1)
    np.clip(out[12:], 0, 255, out=out[12:])
    return out


def _green_neighbours(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Green as a row of numbers, and its predictions."""
    width = pixels.shape[1]
    green = ((pixels.ravel() >> np.uint32(8)) & np.uint32(255)).astype(np.int16)
    padded, n = np.concatenate([np.zeros(width + 1, np.int16), green]), len(green)
    return green, green_predictions(padded[width : width + n], padded[1 : n + 1], padded[2 : n + 2] if width > 1 else padded[1 : n + 1], padded[:n])


def best_modes(pixels: np.ndarray, size_bits: int) -> np.ndarray:
    """The predictor's small image: each tile has the mode whose differences of green are least in sum, the lowest of equals."""
    green, guesses = _green_neighbours(pixels)
    off = np.abs((green - guesses).astype(np.int8)).view(np.uint8).reshape(14, *pixels.shape)
    for axis in (1, 2):
        off = np.add.reduceat(off, np.arange(0, off.shape[axis], 1 << size_bits), axis=axis, dtype=np.int32)
    return (off.argmin(axis=0).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)


def undo_green_predictors(images: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """``undo_predictor`` of several images ``(pixels, modes, size_bits)`` of which only green differs from its predictions.

    Pixels with one sum of column and twice the row are ready together, in all images at once."""
    fronts, widths, modes, bases, sizes = [], [], [], [], []
    for pixels, tiles, size_bits in images:
        height, width = pixels.shape
        fronts.append((2 * np.arange(height, dtype=np.uint16)[:, None] + np.arange(width, dtype=np.uint16)).ravel())
        mode = _modes(tiles, size_bits, height, width).ravel()
        modes.append(np.where(mode > 13, 0, mode))
        widths.append(np.full(pixels.size, width, np.int64))
        bases.append(sum(sizes))
        sizes.append(pixels.size)
    front, mode, wide = np.concatenate(fronts), np.concatenate(modes), np.concatenate(widths)
    left_over = np.concatenate([((p.ravel() >> np.uint32(8)) & np.uint32(255)).astype(np.int16) for p, _, _ in images])
    order = np.argsort(front, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    wide, mode, left_over = wide[order], mode[order], left_over[order]
    # neighbours that lie outside aren't used, as the first row and column have modes of their own
    near = [rank[np.maximum(order - back, 0)] for back in (1, wide, wide - 1, wide + 1)]
    x, at, ends = np.zeros(len(order), np.int16), np.arange(len(order)), np.cumsum(np.bincount(front)).tolist()
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        guesses = green_predictions(*[x[n[a:b]] for n in near])
        x[a:b] = (left_over[a:b] + guesses[mode[a:b], at[: b - a]]) & 255
    green = (x[rank].astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    return [green[base : base + size].reshape(pixels.shape) for base, size, (pixels, _, _) in zip(bases, sizes, images, strict=True)]


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """A pixel needs its left and upper right neighbours: those with one sum of column and twice the row are ready together."""
    if not (pixels & np.uint32(NOT_GREEN)).any():
        return undo_green_predictors([(pixels, modes, size_bits)])[0]
    height, width = pixels.shape
    mode = _modes(modes, size_bits, height, width)
    x = channels(pixels).astype(np.int64)
    inner = np.unique(mode[1:, 1:]).tolist()
    if inner in ([], [1]):
        # each from its left neighbour alone
        x[1:, 0] = (x[0, 0] + [0, 0, 0, 255] + np.cumsum(x[1:, 0], axis=0)) & 255
        x[0, 0] = (x[0, 0] + [0, 0, 0, 255]) & 255
        return joined(np.cumsum(x, axis=1) & 255)
    x = x.reshape(-1, 4)
    # the pixel right of a row's last one is the next row's first
    for front in range(width + 2 * height - 2):
        row = np.arange(max(0, (front - width + 2) // 2), min(height, front // 2 + 1))
        at = row * width + front - 2 * row
        near = [x[np.maximum(at - back, 0)] for back in (1, width, width - 1, width + 1)]
        x[at] = (x[at] + predict(mode.reshape(-1)[at], *near)) & 255
    return joined(x.reshape(height, width, 4))


def apply_predictor(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    if (pixels & np.uint32(NOT_GREEN) == 0xFF000000).all():
        green, guesses = _green_neighbours(pixels)
        mode = _modes(modes, size_bits, height, width).ravel()
        return ((green - guesses[np.where(mode > 13, 0, mode), np.arange(len(green))]) & 255).astype(np.uint32).reshape(height, width) << np.uint32(8)
    x = channels(pixels).astype(np.int64).reshape(-1, 4)
    at = np.arange(len(x))
    near = [x[np.maximum(at - back, 0)] for back in (1, width, width - 1, width + 1)]
    return joined(((x - predict(_modes(modes, size_bits, height, width).reshape(-1), *near)) & 255).reshape(height, width, 4))


def undo_cross_color(pixels: np.ndarray, tiles: np.ndarray, size_bits: int, sign: int = 1) -> np.ndarray:
    """With ``sign`` -1 the transform itself."""
    height, width = pixels.shape
    each = channels(tiles).view(np.int8).astype(np.int16)
    if tiles.size > 1:
        each = each[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    green_to_red, green_to_blue, red_to_blue = each[..., 0], each[..., 1], each[..., 2]
    # products of two signed bytes fit in 16 bits, and sums are taken modulo 256
    channel = lambda shift: (pixels >> np.uint32(shift)).astype(np.uint8)
    move = lambda factor, by: ((factor * by.view(np.int8).astype(np.int16)) >> 5).astype(np.uint8) * np.uint8(sign & 255)
    green, red = channel(8), channel(16)
    moved = red + move(green_to_red, green)
    blue = channel(0) + move(green_to_blue, green) + move(red_to_blue, moved if sign > 0 else red)
    return (pixels & np.uint32(0xFF00FF00)) | (moved.astype(np.uint32) << np.uint32(16)) | blue


def undo_subtract_green(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    """With ``sign`` -1 the transform itself."""
    x = channels(pixels).astype(np.int64)
    x[..., [0, 2]] = (x[..., [0, 2]] + sign * x[..., 1:2]) & 255
    return joined(x)


def undo_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(table))
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if bits:
        each = 8 >> bits
        parts = (index[..., None] >> (each * np.arange(1 << bits))) & ((1 << each) - 1)
        index = parts.reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def palette_bits(size: int) -> int:
    """Pixels of small palettes share a byte: log2 of how many."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def parse_vp8l(data: bytes, later: bool = False) -> tuple[np.ndarray | Unread, list[tuple]]:
    """The stored pixels, and the transforms to undo, last first: ``(kind, its small image or table, size bits or width)``."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("an unknown version")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            size_bits = bits.read(3) + 2
            tiles = read_image(bits, -(-inner >> size_bits), -(-height >> size_bits), False)
            undo.append((kind, tiles, size_bits))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind,))
        else:
            table = read_image(bits, bits.read(8) + 1, 1, False)[0]
            table = joined(np.cumsum(channels(table).astype(np.int64), axis=0) & 255)
            undo.append((kind, table, inner))
            inner = -(-inner >> palette_bits(len(table)))
    return read_image(bits, inner, height, True, later), undo[::-1]


UNDO = {PREDICTOR: undo_predictor, CROSS_COLOR: undo_cross_color, SUBTRACT_GREEN: undo_subtract_green, PALETTE: undo_palette}


def decode_vp8l(data: bytes) -> np.ndarray:
    pixels, undo = parse_vp8l(data)
    for kind, *how in undo:
        pixels = UNDO[kind](pixels, *how)
    return pixels


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of lossless WebP files; pixels and predictors of green alone are read and undone in all of them at once."""
    images = [parse_vp8l(chunk_of(f)[0], True) for f in files]
    out: list[np.ndarray] = [pixels for pixels, _ in images]
    unread = [k for k, pixels in enumerate(out) if isinstance(pixels, Unread)]
    if unread:
        for k, pixels in zip(unread, pixels_together([out[k] for k in unread]), strict=True):
            out[k] = pixels
    left = [undo for _, undo in images]
    while any(left):
        together = []
        for k, undo in enumerate(left):
            while undo and not (undo[0][0] == PREDICTOR and not (out[k] & np.uint32(NOT_GREEN)).any()):
                kind, *how = undo.pop(0)
                out[k] = UNDO[kind](out[k], *how)
            together += [k] if undo else []
        if together:
            undone = undo_green_predictors([(out[k], *left[k].pop(0)[1:]) for k in together])
            for k, pixels in zip(together, undone, strict=True):
                out[k] = pixels
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Pixels of the lossless WebP file that ``data`` begins with, and the file's size."""
    chunk, end = chunk_of(data)
    return decode_vp8l(chunk), end


def chunk_of(data: bytes) -> tuple[bytes, int]:
    """The lossless image in the file that ``data`` begins with, and the file's size."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    end = 8 + int.from_bytes(data[4:8], "little")
    at = 12
    while at + 8 <= min(end, len(data)):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size], end
        at += 8 + size + (size & 1)
    raise WebpError("no lossless image in the file")


# --- encoder ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code of at most ``limit`` bits; counts are levelled until it fits."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used or [0]] = 1
        return lengths
    weights = counts[used]
    order = np.argsort(weights, kind="stable")
    n, own, weights = len(used), np.array(used)[order], weights[order].tolist()
    while True:
        # leaves in order of weight, then the nodes made of them, which come in order too: the lighter head of both is next
        weight = [*weights, *[0] * (n - 1)]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for node in range(n, 2 * n - 1):
            if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                a, leaf = leaf, leaf + 1
            else:
                a, inner = inner, inner + 1
            if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                b, leaf = leaf, leaf + 1
            else:
                b, inner = inner, inner + 1
            parent[a] = parent[b] = node
            weight[node] = weight[a] + weight[b]
        depth = parent
        depth[-1] = 0
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if depth[0] <= limit:
            lengths[own] = depth[:n]
            return lengths
        weights = [(w + 1) // 2 + sum(weights) // (1 << limit) for w in weights]


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def write_code(out: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code's lengths: simple for one symbol, else with runs of zeros."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        out.put(0b101, 3)
        out.put(int(used[0]), 8)
        return
    symbols: list[tuple[int, int, int]] = []
    for value, run in groupby(lengths.tolist()):
        n = len(list(run))
        while value == 0 and n >= 3:
            take = min(n, 138)
            symbols.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            n -= take
        symbols += [(value, 0, 0)] * n
    counts = [0] * 19
    for which, _, _ in symbols:
        counts[which] += 1
    small = code_lengths(np.array(counts), 7)
    codes, bits = reversed_codes(small).tolist(), small.tolist()
    out.put(0, 1)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if bits[s])
    last = max(last, 3)
    out.put(last + 1 - 4, 4)
    for s in LENGTH_ORDER[: last + 1]:
        out.put(bits[s], 3)
    out.put(0, 1)
    if np.count_nonzero(small) < 2:
        bits = [0] * 19
    value = size = 0
    for which, extra, n in symbols:
        value |= (codes[which] | extra << bits[which]) << size
        size += bits[which] + n
    out.put(value, size)


#: Longest code, and longest copy.
LIMIT, MAX_COPY = 15, 4096


def prefix_parts(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of lengths and distance codes from 1 on."""
    if not len(value):
        return value, value, value
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    small = v < 4
    extra = np.where(small, 0, high - 1)
    symbol = np.where(small, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return symbol, np.where(small, 0, v & ((1 << extra) - 1)), extra


def find_copies(x: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(place, length, distance)`` of copies of ``least`` pixels or more, first come first served."""
    return copies_of_all(x, np.array([0, len(x)]), least)[0]


def copies_of_all(x: np.ndarray, first: np.ndarray, least: int) -> list[list[tuple[int, int, int]]]:
    """``find_copies`` of images that stand one after the other, ``first`` being n+1 offsets.

    A place's candidate is the nearest earlier one with the same ``least`` pixels, among those that share a short hash."""
    n, images = len(x) - least + 1, range(len(first) - 1)
    if n < 2:
        return [[] for _ in images]
    wide = x.astype(np.uint64)
    key = wide[:n].copy()
    for k in range(1, least):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += wide[k : n + k]
    order = np.argsort(((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_key = key[order]
    same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    where, found = places.tolist(), before[places].tolist()
    out = []
    for base, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        copies, at = [], base
        k = bisect_left(where, base)
        while (k := bisect_left(where, at, k)) < len(where) and where[k] <= end - least:
            at = where[k]
            back = at - found[k]
            if found[k] < base:
                at += 1
                continue
            size = least
            while True:
                room = min(size * 4, MAX_COPY, end - at)
                differ = (x[at : at + room] != x[at - back : at - back + room]).nonzero()[0]
                size = int(differ[0]) if len(differ) else room
                if len(differ) or room == min(MAX_COPY, end - at):
                    break
            if size >= least:
                copies.append((at - base, size, back))
                at += size
            else:
                at += 1
        out.append(copies)
    return out


def tokens_of(x: np.ndarray, copies: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray:
    """Rows (kind, a, b) in order: kind 0 is a literal pixel a, 1 a copy of length a from distance b, 2 the cached pixel a."""
    literal = np.ones(len(x), bool)
    for at, size, _ in copies:
        literal[at + 1 : at + size] = False
    where = np.flatnonzero(literal)
    out = np.zeros((len(where), 3), np.int64)
    out[:, 1] = x[where]
    if cache_bits:
        slot = cache_slots(x, cache_bits)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        held = np.zeros(len(x), bool)
        held[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (x[order[1:]] == x[order[:-1]])
        hits = held[where]
        out[hits, 0], out[hits, 1] = 2, slot[where[hits]]
    if copies:
        rows = np.searchsorted(where, [c[0] for c in copies])
        out[rows] = [(1, size, back) for _, size, back in copies]
    return out


class Symbols:
    """What an image's tokens are written as: the first symbol of each, other channels of literals, lengths and distances of copies."""

    def __init__(self, tokens: np.ndarray, cache_bits: int):
        kind, a, b = tokens.T
        self.literal, self.copy = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        pixel = a[self.literal]
        self.first = a + 280
        self.first[self.literal] = (pixel >> 8) & 255
        self.others = [(pixel >> shift) & 255 for shift in (16, 0, 24)]
        length, self.length_extra, self.length_bits = prefix_parts(a[self.copy])
        self.first[self.copy] = 256 + length
        self.far, self.far_extra, self.far_bits = prefix_parts(b[self.copy] + 120)
        sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
        self.counts = [np.bincount(x, minlength=n) for x, n in zip([self.first, *self.others, self.far], sizes, strict=True)]

    def bits(self) -> float:
        """About the size of the image."""
        return bits_needed(self.counts) + float(self.length_bits.sum() + self.far_bits.sum())


def bits_needed(counts: list[np.ndarray]) -> float:
    """Entropy of the symbols in bits, and some for each symbol's code length."""
    total = 0.0
    for c in counts:
        c = c[c > 0].astype(np.float64)
        if len(c) > 1:
            total += float(c @ np.log2(c.sum() / c)) + 5 * len(c) + 40
    return total


def write_image(out: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None) -> None:
    if not main and (pixels == pixels[0, 0]).all():
        value = int(pixels[0, 0])
        out.put(0, 1)
        for symbol in (value >> 8 & 255, value >> 16 & 255, value & 255, value >> 24, 0):
            out.put(symbol << 3 | 0b101, 11)
        return
    symbols = Symbols(tokens_of(pixels.ravel(), copies or [], cache_bits), cache_bits)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    tables = []
    for c in symbols.counts:
        if np.count_nonzero(c) < 2 and (only := int(c.argmax())) < 256:
            out.put(only << 3 | 0b101, 11)
            tables.append(None)
            continue
        lengths = code_lengths(c, LIMIT)
        write_code(out, lengths)
        tables.append((reversed_codes(lengths).astype(np.uint64), lengths) if np.count_nonzero(lengths) > 1 else None)
    # a token takes 4 codes of 15 bits at most, or 2 and up to 28 bits that are written as they are
    n = len(symbols.first)
    value, size = (tables[0][0][symbols.first], tables[0][1][symbols.first]) if tables[0] else (np.zeros(n, np.uint64), np.zeros(n, np.int64))

    def follow(rows: np.ndarray, code: np.ndarray, bits: np.ndarray) -> None:
        value[rows] |= code.astype(np.uint64) << size[rows].astype(np.uint64)
        size[rows] += bits

    for table, x in zip(tables[1:4], symbols.others, strict=True):
        if table:
            follow(symbols.literal, table[0][x], table[1][x])
    if len(symbols.copy):
        follow(symbols.copy, symbols.length_extra, symbols.length_bits)
        if tables[4]:
            follow(symbols.copy, tables[4][0][symbols.far], tables[4][1][symbols.far])
        follow(symbols.copy, symbols.far_extra, symbols.far_bits)
    out.put(*joined_bits(value, size))


def joined_bits(value: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """Fields of up to 63 bits one after the other, lowest bit first, as one number; and its size."""
    ends = np.cumsum(size)
    start = ends - size
    total = int(ends[-1])
    word, shift = start >> 6, (start & 63).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros((total >> 6) + 2, np.uint64)
    # bits of different fields differ in place, so that a sum joins them
    words[word[heads]] = np.add.reduceat(value << shift, heads)
    over = np.flatnonzero((start & 63) + size > 64)
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return int.from_bytes(words.astype("<u8").tobytes(), "little"), total


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: list[tuple[int, int, int]] | int | None = None) -> bytes:
    """A lossless WebP file of ARGB pixels.

    ``transforms`` are applied in order: ``(PREDICTOR, size_bits, modes)``, ``(CROSS_COLOR, size_bits, tiles)``, ``(SUBTRACT_GREEN,)`` or
    ``(PALETTE, colours)``; tiles are small images as the format stores them. ``copies`` are those of the transformed pixels, or the
    least length of those to look for."""
    height, width = pixels.shape
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise WebpError("sides are 1 to 16384 pixels")
    alpha = int(bool((pixels >> np.uint32(24) != 255).any()))
    written = []
    for kind, *how in transforms:
        if kind == PALETTE:
            parts = channels(how[0]).astype(np.int64)
            written.append((kind, len(how[0]) - 1, joined(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255)[None, :]))
        else:
            written.append((kind, *how) if how else (kind, 0, None))
        pixels = transformed(pixels, (kind, *how))
    return _file(width, height, alpha, written, pixels, cache_bits, find_copies(pixels.ravel(), copies) if isinstance(copies, int) else copies)


def predicted_together(greens: list[np.ndarray], size_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``best_modes`` and ``apply_predictor`` of images of one width in which only green differs; ``greens`` are their bytes."""
    width, tile = greens[0].shape[1], 1 << size_bits
    heights = [len(g) for g in greens]
    none = np.zeros(width + 1, np.int16)
    # a row of zeros and one more before each image are what lies outside
    flat = np.concatenate([x for g in greens for x in (none, g.ravel().astype(np.int16))])
    begins = np.cumsum([0, *(h * width + width + 1 for h in heights[:-1])]) + width + 1
    n = len(flat) - width - 1
    guesses = green_predictions(flat[width : width + n], flat[1 : n + 1], flat[2 : n + 2], flat[:n])
    green = flat[width + 1 :]
    off = np.abs((green - guesses).astype(np.int8)).view(np.uint8)
    out = []
    for begin, height in zip((begins - width - 1).tolist(), heights, strict=True):
        here = slice(begin, begin + height * width)
        sums = np.add.reduceat(off[:, here].reshape(14, height, width), np.arange(0, height, tile), axis=1, dtype=np.int32)
        sums = np.add.reduceat(sums, np.arange(0, width, tile), axis=2) if width % tile else sums.reshape(14, len(sums[0]), -1, tile).sum(axis=3)
        modes = sums.argmin(axis=0)
        each = np.repeat(np.repeat(modes, tile, axis=0)[:height], tile, axis=1)[:, :width]
        each[0], each[:, 0] = 1, 2
        each[0, 0] = 0
        guess = guesses[:, here][each.ravel(), np.arange(height * width)]
        left_over = ((green[here] - guess) & 255).astype(np.uint32) << np.uint32(8)
        out.append(((modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), left_over.reshape(height, width)))
    return out


def encode_greys(greys: list[np.ndarray], size_bits: int, cache_bits: int, least: int) -> list[bytes]:
    """Files of grey images of one width, given as bytes, each as ``encode`` gives it with cross-colour of factors 1 in tiles
    of 512, the predictor of ``best_modes``, a colour cache and copies."""
    predicted = predicted_together(greys, size_bits)
    together = np.concatenate([left_over.ravel() for _, left_over in predicted])
    copies = copies_of_all(together, np.cumsum([0, *(g.size for g in greys)]), least)
    out = []
    for (modes, left_over), own in zip(predicted, copies, strict=True):
        height, width = left_over.shape
        same = np.full((-(-height >> 9), -(-width >> 9)), 0xFF000000 | 32 << 8 | 32, np.uint32)
        out.append(_file(width, height, 0, [(CROSS_COLOR, 9, same), (PREDICTOR, size_bits, modes)], left_over, cache_bits, own))
    return out


def _file(width: int, height: int, alpha: int, transforms: list[tuple], pixels: np.ndarray, cache_bits: int, copies: list[tuple[int, int, int]] | None) -> bytes:
    """A file of transformed pixels; ``transforms`` are kinds, what follows them in bits, and small images."""
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(alpha, 1)
    out.put(0, 3)
    for kind, number, small in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOR):
            out.put(number - 2, 3)
        elif kind == PALETTE:
            out.put(number, 8)
        if small is not None:
            write_image(out, small, False)
    out.put(0, 1)
    write_image(out, pixels, True, cache_bits, copies)
    data = out.value.to_bytes((out.size + 7) // 8, "little")
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def transformed(pixels: np.ndarray, transform: tuple) -> np.ndarray:
    kind, *how = transform
    if kind == PREDICTOR:
        return apply_predictor(pixels, how[1], how[0])
    if kind == CROSS_COLOR:
        return undo_cross_color(pixels, how[1], how[0], -1)
    if kind == SUBTRACT_GREEN:
        return undo_subtract_green(pixels, -1)
    # palette: places in the table, several of them in the green byte of one pixel where it is small
    place = np.argsort(how[0])[np.searchsorted(np.sort(how[0]), pixels)]
    bits = palette_bits(len(how[0]))
    each, wide = 8 >> bits, -(-pixels.shape[1] >> bits) << bits
    padded = np.zeros((len(place), wide), np.int64)
    padded[:, : place.shape[1]] = place
    packed = (padded.reshape(len(place), -1, 1 << bits) << (each * np.arange(1 << bits))).sum(-1)
    return ((packed << 8) | 0xFF000000).astype(np.uint32)
