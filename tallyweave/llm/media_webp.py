"""Media columns: lossless WebP (VP8L, RFC 9649) in numpy.

`decode` reads any lossless stream: prefix codes, meta prefix images, back-references, colour cache,
and the predictor, cross-colour, subtract-green and palette transforms. `encode` writes all of them.

`store` / `load` keep any bytes as pixels, four bytes a pixel. An image is 16 pixels wide and at most
16,384 high; longer payloads go into several images, one after another. For each image `store` compares the
entropy of its channels as they are and after each transform, takes the cheapest, and writes what is left by
Huffman codes with back-references and a colour cache (`compact`, whole arrays at a time).

Defined cases: a null or empty text is stored as 64 zero bytes; equal texts give equal values; repeated
rows are kept; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_ids, whole_id

WIDTH, MAX_HEIGHT = 16, 16_384

# Fixed values of the format: order of the code length codes, repeat codes, and the distance map's
# 120 neighbours in order (rows of x, y offsets).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3


def _neighbours() -> list[tuple[int, int]]:
    """The 120 nearest earlier pixels as (x, y) offsets: nearest first, then the least |x|, then x > 0."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(near, key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), p[0] < 0))


NEIGHBOURS = _neighbours()


@lru_cache(maxsize=1)
def _mirror() -> np.ndarray:
    """Numbers of 16 bits with their bits in opposite order."""
    x = np.arange(1 << 16, dtype=np.uint32)
    for k in (1, 2, 4, 8):
        mask = np.uint32(sum(((1 << k) - 1) << n for n in range(0, 16, 2 * k)))
        x = (x >> np.uint32(k)) & mask | (x & mask) << np.uint32(k)
    return x


@lru_cache(maxsize=17)
def _mirrored(bits: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse."""
    return _mirror()[np.arange(1 << bits) << (16 - bits)].astype(np.int64)


@lru_cache(maxsize=1)
def _mirror_list() -> list[int]:
    return _mirror().tolist()


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a code in order of their words, and the lengths of these."""
    used = lengths.nonzero()[0]
    n = lengths[used]
    order = n.argsort(kind="stable")
    return used[order], n[order].astype(np.int64)


def _words(lengths: np.ndarray) -> np.ndarray:
    """For each symbol its word, first bit lowest, and above 16 bits the number of its bits; a lone symbol takes none."""
    words = np.zeros(len(lengths), np.int64)
    used, n = _in_order(lengths)
    if len(used) > 1:
        share = np.int64(1) << (15 - n)
        words[used] = _mirror()[(share.cumsum() - share) >> (15 - n)] >> (16 - n) | n << 16
    return words


def _canonical(lengths) -> dict[int, tuple[int, int]]:
    """Symbol -> (word with its first bit lowest, number of bits); a lone symbol takes no bits."""
    used = sorted([n << 16 | s for s, n in enumerate(lengths) if n])
    if len(used) == 1:
        return {used[0] & 0xFFFF: (0, 0)}
    out, word, mirror = {}, 0, _mirror_list()
    for held in used:
        n = held >> 16
        out[held & 0xFFFF] = (mirror[word << 1], n)
        word += 1 << 15 - n
    return out


def _prefixed(value: int) -> tuple[int, int, int]:
    """A length or distance from 1 on as (symbol, extra bits, their value)."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = (value - 1) >> (high - 1) & 1
    return 2 * high + second, high - 1, (value - 1) & ((1 << (high - 1)) - 1)


# --- pixels and transforms, one argb integer a pixel -----------------------------------------------


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sub(a: int, b: int) -> int:
    return sum((((a >> k & 255) - (b >> k & 255)) & 255) << k for k in (0, 8, 16, 24))


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(f, *pixels: int) -> int:
    return sum(max(0, min(255, f(*(p >> k & 255 for p in pixels)))) << k for k in (0, 8, 16, 24))


def _halfway(a: int, b: int) -> int:
    return a + int((a - b) / 2)


def _select(left: int, top: int, corner: int) -> int:
    gaps = [0, 0]
    for k in (0, 8, 16, 24):
        guess = (left >> k & 255) + (top >> k & 255) - (corner >> k & 255)
        gaps[0] += abs(guess - (left >> k & 255))
        gaps[1] += abs(guess - (top >> k & 255))
    return left if gaps[0] < gaps[1] else top


#: Fixed order of the predictors: left, top, top right, top left.
PREDICTORS = (
    lambda l, t, r, c: 0xFF000000,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _mean(_mean(l, r), t),
    lambda l, t, r, c: _mean(l, c),
    lambda l, t, r, c: _mean(l, t),
    lambda l, t, r, c: _mean(c, t),
    lambda l, t, r, c: _mean(t, r),
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _each(lambda x, y, z: x + y - z, l, t, c),
    lambda l, t, r, c: _each(_halfway, _mean(l, t), c),
)


def _guess(px, at: int, x: int, y: int, width: int, mode: int) -> int:
    if y == 0:
        return px[at - 1] if x else 0xFF000000
    if x == 0:
        return px[at - width]
    return PREDICTORS[mode if mode < 14 else 0](px[at - 1], px[at - width], px[at - width + 1], px[at - width - 1])


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _crossed(px: int, element: int, sign: int) -> int:
    """Cross-colour: element holds red-to-blue, green-to-blue, green-to-red from the top byte down."""
    to_red, to_blue, red_to_blue = (_signed(element >> k & 255) for k in (0, 8, 16))
    green, red, blue = _signed(px >> 8 & 255), px >> 16 & 255, px & 255
    new_red = (red + sign * ((to_red * green) >> 5)) & 255
    from_red = _signed(new_red if sign > 0 else red)
    new_blue = (blue + sign * ((to_blue * green) >> 5) + sign * ((red_to_blue * from_red) >> 5)) & 255
    return (px & 0xFF00FF00) | new_red << 16 | new_blue


_SIGNED = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)


@lru_cache(maxsize=256)
def _share(slope: int) -> np.ndarray:
    """What cross-colour adds by a slope (a byte) for each byte of green."""
    return (_signed(slope) * _SIGNED >> 5).astype(np.uint8)


def _crossed_all(px: np.ndarray, side: list, width: int, height: int, size: int, sign: int) -> np.ndarray:
    """`_crossed` for all pixels at once."""
    if len(side) == 1 and not side[0] >> 16 & 255:  # what is added depends on the green byte alone
        out = px.view(np.uint8).reshape(-1, 4).copy()
        for channel, k in ((2, 0), (0, 8)):
            more = _share(side[0] >> k & 255)[out[:, 1]]
            out[:, channel] += more if sign > 0 else -more
        return out.reshape(-1).view("<u4")
    element = np.array(side, np.uint32)
    if len(side) > 1:
        across, at = -(-width >> size), np.arange(width * height)
        element = element[(at // width >> size) * across + (at % width >> size)]
    to_red, to_blue, red_to_blue = ((element >> k & 255).astype(np.uint8).view(np.int8).astype(np.int32) for k in (0, 8, 16))
    channels = px.view(np.uint8).reshape(-1, 4)
    green, red, blue = channels[:, 1].view(np.int8).astype(np.int32), channels[:, 2].astype(np.int32), channels[:, 0].astype(np.int32)
    new_red = (red + sign * ((to_red * green) >> 5)) & 255
    from_red = (new_red if sign > 0 else red).astype(np.uint8).view(np.int8).astype(np.int32)
    new_blue = (blue + sign * ((to_blue * green) >> 5) + sign * ((red_to_blue * from_red) >> 5)) & 255
    return (px & np.uint32(0xFF00FF00)) | (new_red << 16 | new_blue).astype(np.uint32)


def _green(px: int, sign: int) -> int:
    g = px >> 8 & 255
    return (px & 0xFF00FF00) | ((px >> 16 & 255) + sign * g & 255) << 16 | ((px & 255) + sign * g & 255)


def _bundle_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


# --- reading -------------------------------------------------------------------------------------


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(64), 0

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 9], "little") >> (self.at & 7)

    def ahead(self, n: int) -> int:
        """The next n bits, which stay."""
        return int.from_bytes(self.data[self.at >> 3 : self.at + n + 7 >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


#: Stands for the place after a copy, whose end is read only if the walk comes there.
STOP = 1 << 40


class _Code:
    """A prefix code; its table is made only when single symbols are read."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths, np.uint8)
        often = np.bincount(self.lengths).tolist()  # how many words there are of each length
        words = len(self.lengths) - often[0]
        if not words:
            raise ValueError("a prefix code has no symbol")
        self.widest = len(often) - 1 if words > 1 else 0
        if self.widest and sum([c << self.widest - n for n, c in enumerate(often) if n]) != 1 << self.widest:
            raise ValueError("a prefix code is not complete")
        self.table = self.words = self.entries = self.bits = None

    def look(self) -> list[int]:
        """For the next bits the symbol, in sixteenths, and the length of its word."""
        if self.table is None:
            self.table = self.looked().tolist()
        return self.table

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols in order of their words, the lengths of these, and of how many next bits each is the begin."""
        if self.words is None:
            used, n = _in_order(self.lengths)
            n = n if self.widest else np.zeros(1, np.int64)
            self.words = used, n, 1 << (self.widest - n)
        return self.words

    def by_bits(self, of_words: np.ndarray, width: int) -> np.ndarray:
        """What is given for each word, for each value of the next `width` bits (`widest` at least)."""
        found = of_words.repeat(self.known()[2]).take(_mirrored(self.widest))
        return np.tile(found, 1 << width - self.widest) if width > self.widest else found

    def looked(self) -> np.ndarray:
        """`look` as an array."""
        if self.entries is None:
            used, n, _ = self.known()
            self.entries = self.by_bits(used << 4 | n, self.widest)
        return self.entries

    def spans(self, width: int) -> np.ndarray:
        """For the next `width` bits the length of the word alone."""
        if self.bits is None or len(self.bits) != 1 << width:
            self.bits = self.by_bits(self.known()[1], width)
        return self.bits

    def steps(self, width: int, slot: int) -> np.ndarray:
        """For the next `width` bits, in a code of green: the length of the word for a colour, `slot` more for a slot of
        the cache, STOP for what begins a copy."""
        used, n, _ = self.known()
        return self.by_bits(np.where(used < 256, n, np.where(used < 280, STOP, n + slot)), width)

    def read(self, reader: _Reader) -> int:
        found = self.look()[reader.peek() & ((1 << self.widest) - 1)]
        reader.at += found & 15
        return found >> 4

    def even(self, below: int = 256) -> np.ndarray | None:
        """The symbols in order of their words if all words have `widest` bits and all are under `below`."""
        used = self.lengths.nonzero()[0]
        if len(used) == 1 << self.widest and used[-1] < below:
            return used.astype(np.uint8)
        return None


@lru_cache(maxsize=4096)
def _code(lengths: bytes) -> _Code:
    return _Code(np.frombuffer(lengths, np.uint8))


@lru_cache(maxsize=4096)
def _length_words(outer: bytes) -> dict[int, tuple[int, int]]:
    return _canonical(outer)


@lru_cache(maxsize=4096)
def _length_table(outer: bytes) -> tuple[list[tuple[int, int]], int]:
    """For the next bits the code of a length and the number of its bits, and how many bits are looked at."""
    used = [n for n in outer if n]
    if not used:
        raise ValueError("a prefix code has no symbol")
    if len(used) > 1 and sum([1 << 7 - n for n in used]) != 1 << 7:
        raise ValueError("a prefix code is not complete")
    words = _length_words(outer)
    widest = max(used) if len(used) > 1 else 0
    table = [(0, 0)] * (1 << widest)
    for symbol, (word, n) in words.items():
        table[word :: 1 << n] = [(symbol, n)] * (1 << widest - n)
    return table, widest


def _read_code(r: _Reader, alphabet: int) -> _Code:
    if r.bits(1):
        lengths = [0] * alphabet
        two, wide = r.bits(1), r.bits(1)
        symbols = [r.bits(8 if wide else 1)] + ([r.bits(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return _code(bytes(lengths))
    outer, head = bytearray(19), r.ahead(62)  # all up to the bit that tells whether their number is given
    count = 4 + (head & 15)
    for n in range(count):
        outer[CODE_LENGTH_ORDER[n]] = head >> 4 + 3 * n & 7
    r.at += 5 + 3 * count
    (table, widest), left = _length_table(bytes(outer)), alphabet
    if head >> 4 + 3 * count & 1:
        left = 2 + r.bits(2 + 2 * r.bits(3))
    if left == alphabet and widest <= 1 and max(table)[0] < 16:  # all at once: no repeats
        if not widest:
            return _code(bytes([table[0][0]]) * alphabet)
        raw = np.frombuffer(r.data, np.uint8)[r.at >> 3 : (r.at + alphabet + 7 >> 3) + 1]
        bits = np.unpackbits(raw, bitorder="little")[r.at & 7 :][:alphabet]
        r.at += alphabet
        return _code(np.array([table[0][0], table[1][0]], np.uint8)[bits].tobytes())
    mask, lengths = (1 << widest) - 1, bytearray()
    add = lengths.append
    byte, have = (r.at >> 3) + 32, 256 - (r.at & 7)
    held = int.from_bytes(r.data[byte - 32 : byte], "little") >> (r.at & 7)
    for _ in range(left):
        if have < 16:
            held |= int.from_bytes(r.data[byte : byte + 32], "little") << have
            byte, have = byte + 32, have + 256
        symbol, n = table[held & mask]
        held >>= n
        have -= n
        if symbol < 16:
            add(symbol)
        else:
            more, extra = ((3, 2), (3, 3), (11, 7))[symbol - 16]
            again = lengths.rstrip(b"\0")[-1:] or b"\x08" if symbol == 16 else b"\0"
            lengths += again * (more + (held & ((1 << extra) - 1)))
            held >>= extra
            have -= extra
        if len(lengths) >= alphabet:
            break
    r.at = 8 * byte - have
    return _code(bytes(lengths[:alphabet]).ljust(alphabet, b"\0"))


def _read_codes(r: _Reader, slots: int) -> list[_Code]:
    """The five codes of a group; a code that is spelt like the one before it is not read again."""
    codes, spelt = [_read_code(r, 280 + slots)], None
    for _ in range(3):
        if spelt is None or r.ahead(size) != spelt:
            begin = r.at
            codes.append(_read_code(r, 256))
            size, r.at = r.at - begin, begin
            spelt = r.ahead(size)
        else:
            codes.append(codes[-1])
        r.at += size
    return [*codes, _read_code(r, 40)]


def _amount(r: _Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.bits(extra) + 1


def _read_pixels(r: _Reader, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, tile, tiles, across = 1, 0, None, 0
    if top and r.bits(1):
        tile = r.bits(3) + 2
        across = -(-width >> tile)
        tiles = (_read_pixels(r, across, -(-height >> tile), False) >> 8 & 0xFFFF).tolist()
        groups = max(tiles) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes = [_read_codes(r, len(cache)) for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache and all((even := [c.even() for c in codes[0][:4]])[k] is not None for k in range(4)):
        return _read_even(r, codes[0], even, total)
    if tiles is None:
        return _read_tokens(r, codes[0], width, total, cache, cache_bits)
    px: list[int] = []
    while len(px) < total:
        at = len(px)
        group = codes[tiles[(at // width >> tile) * across + (at % width >> tile)]]
        g = group[0].read(r)
        if g < 256:
            red, blue, alpha = (group[k].read(r) for k in (1, 2, 3))
            new = [alpha << 24 | red << 16 | g << 8 | blue]
        elif g < 280:
            length = _amount(r, g - 256)
            new = _copied(px, length, _amount(r, group[4].read(r)), width, total)
        else:
            new = [cache[g - 280]]
        px += new
        for p in new if cache else ():
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(px, np.uint32)


def _distance(code: int, width: int) -> int:
    """How many pixels back a distance code means; small ones are those of the map of neighbours."""
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _copied(px: list[int], length: int, code: int, width: int, total: int) -> list[int]:
    """The pixels of a back-reference."""
    at, back = len(px), _distance(code, width)
    if back > at or at + length > total:
        raise ValueError("a back-reference leaves the image")
    return (px[at - back :] * (length // back + 1))[:length] if length > back else px[at - back : at - back + length]


#: So many bits of the stream are looked up at once; a token takes under 64.
STRETCH = 1 << 14
_PLACES = np.arange(STRETCH + 256)
_SHIFTS = _PLACES & 7


def _read_tokens(r: _Reader, codes: list[_Code], width: int, total: int, cache: list[int], cache_bits: int) -> np.ndarray:
    """The pixels of one code group. For each bit of a stretch it is looked up where a token that begins there
    ends; only the walk from one token to the next is a loop."""
    green, red, blue, alpha, distance = codes
    masks, widest = {c: (1 << c.widest) - 1 for c in codes}, max(c.widest for c in codes[:4])
    values, copies, have, held = [], [], 0, 0  # held: tokens that are no copies
    while have < total:
        base, first = r.at >> 3, r.at & 7
        limit = min(STRETCH, 64 * (total - have) + 8, 8 * (len(r.data) - base) - 128)
        if limit <= first:
            raise ValueError("the stream ends within the image")
        raw = np.frombuffer(r.data, np.uint8, (limit + 7 >> 3) + 12, base).astype(np.int64)
        four = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        seen = four.repeat(8)
        n = len(seen)
        places = _PLACES[:n]
        seen >>= _SHIFTS[:n]
        seen &= (1 << widest) - 1
        after = {c: c.spans(widest).take(seen) for c in {red, blue, alpha}}
        for step in after.values():
            step += places
        # Where a token ends whose green word ends at a place, if it is a colour; then the places themselves, for slots; then STOP, for copies.
        ends = np.empty(2 * n + 1, np.int64)
        after[alpha].take(after[blue].take(after[red], mode="clip"), out=ends[:n], mode="clip")
        ends[n:-1], ends[-1] = places, STOP
        in_red = green.steps(widest, n).take(seen)
        in_red += places
        jump = ends.take(in_red, mode="clip")
        walk, pos, onward = [], first, memoryview(jump)
        while have < total and pos < limit:
            begin = len(walk)
            if onward[pos] == pos:  # no token takes any bits, so all are alike
                walk += [pos] * (total - have)
            else:
                add, here = walk.append, pos
                while here < limit:
                    add(here)
                    here = onward[here]
            last = walk[-1]
            more = len(walk) - begin - (onward[last] >= STOP)
            if have + more >= total:
                del walk[begin + total - have :]
                more = total - have
            have += more
            pos = onward[walk[-1]]
            if have < total and pos >= STOP:
                del walk[-1]
                entry = int(green.looked()[seen[last] & masks[green]])
                r.at = 8 * base + last + (entry & 15)
                length = _amount(r, (entry >> 4) - 256)
                entry = int(distance.looked()[r.peek() & masks[distance]])
                r.at += entry & 15
                copies.append((held + len(walk), length, _amount(r, entry >> 4)))
                have, pos = have + length, r.at - 8 * base
        r.at = 8 * base + pos
        held += len(walk)
        walk = np.frombuffer(array("q", walk), np.int64)
        kind = green.looked().take(seen.take(walk) & masks[green]) >> 4
        argb = kind << 8
        at = in_red.take(walk)
        for c, k in ((red, 16), (blue, 0), (alpha, 24)):
            found = c.looked().take(seen.take(at, mode="clip") & masks[c])
            argb |= found >> 4 << k
            at += found & 15
        values.append(np.where(kind < 256, argb, 279 - kind) if cache else argb)
    return _placed(values[0] if len(values) == 1 else np.concatenate(values), copies, width, total, cache, cache_bits)


def _placed(value: np.ndarray, copies: list[tuple[int, int, int]], width: int, total: int, cache: list[int], cache_bits: int) -> np.ndarray:
    """The pixels of tokens: a colour or a slot of the cache (-1 - slot), and copies as (tokens before it, length,
    distance code). A slot of the cache is brought up to date when it is asked for: with the last pixel of that slot."""
    hits = (value < 0).nonzero()[0] if cache else value[:0]
    if not len(hits) and not copies:
        return value.astype(np.uint32)
    values, px, done, ats, lasts, marks = value.tolist(), [], 0, [], [], []
    if len(hits):
        slots = (value.astype(np.uint32) * np.uint32(0x1E35A7BD) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        slots[hits] = -1 - value[hits]
        at = hits
        if copies:
            of, end = np.empty(total, np.uint16), 0
            for n, length, far in copies:
                of[end : end + n - done] = slots[done:n]
                end, done = end + n - done, n
                back = _distance(far, width)
                if back > end or end + length > total:
                    raise ValueError("a back-reference leaves the image")
                of[end : end + length] = of[end - back : end - back + length] if back >= length else np.resize(of[end - back : end], length)
                end += length
            of[end:] = slots[done:]
            slots, done = of, 0
            starts = [n for n, _, _ in copies]
            marks = hits.searchsorted(starts).tolist()
            added = np.cumsum([0] + [length for _, length, _ in copies])
            at = hits + added.take(np.searchsorted(starts, hits, side="right"))
        order = slots.argsort(kind="stable")
        ranked = slots.take(order)
        again = np.empty(len(slots), bool)  # the place before it in order has the same slot
        again[0] = False
        np.equal(ranked[1:], ranked[:-1], out=again[1:])
        before = np.empty(len(slots), np.int64)
        before[order[1:]] = order[:-1]
        before[order[~again]] = -1
        ats, lasts = at.tolist(), before.take(at).tolist()
    marks = [0, *marks, len(ats)] if ats else [0] * (len(copies) + 2)
    for n, length, far, begin, end in zip(*zip(*copies, (len(values), 0, 0)), marks, marks[1:]):
        px += values[done:n]
        done = n
        for at, last in zip(ats[begin:end], lasts[begin:end]):
            slot = -1 - px[at]
            if last >= 0:
                cache[slot] = px[last]
            px[at] = cache[slot]
        if length:
            px += _copied(px, length, far, width, total)
    if len(px) != total:
        raise ValueError("a copy leaves the image")
    return np.frombuffer(array("I", px), np.uint32)


def _read_even(r: _Reader, codes: list[_Code], symbols: list[np.ndarray], total: int) -> np.ndarray:
    """All pixels at once: each takes the same number of bits."""
    widths = [c.widest for c in codes[:4]]
    each = sum(widths)
    raw = np.frombuffer(r.data, np.uint8)[r.at >> 3 : (r.at + total * each + 7 >> 3) + 1]
    bits = np.unpackbits(raw, bitorder="little")[r.at & 7 :][: total * each].reshape(total, each)
    r.at += total * each
    out, at = np.zeros((total, 4), np.uint8), 0
    if all(len(s) == len(symbols[0]) and (s == symbols[0]).all() for s in symbols):
        if n := widths[0]:  # one alphabet for all channels
            found = symbols[0][np.packbits(bits.reshape(-1, n), axis=1)[:, 0] >> (8 - n)].reshape(total, 4)
            out[:, 0], out[:, 1], out[:, 2], out[:, 3] = found[:, 2], found[:, 0], found[:, 1], found[:, 3]
        else:
            out[:] = symbols[0][0]
        return out.reshape(-1).view("<u4")
    for channel, n, known in zip((1, 2, 0, 3), widths, symbols):
        out[:, channel] = known[np.packbits(bits[:, at : at + n], axis=1)[:, 0] >> (8 - n)] if n else known[0]
        at += n
    return out.reshape(-1).view("<u4")


def _read_image(data: bytes) -> tuple[int, int, np.ndarray]:
    r = _Reader(data)
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    steps, seen, wide = [], set(), width
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = r.bits(3) + 2
            steps.append((kind, wide, size, _read_pixels(r, -(-wide >> size), -(-height >> size), False).tolist()))
        elif kind == PALETTE:
            count = r.bits(8) + 1
            colours, last = [], 0
            for p in _read_pixels(r, count, 1, False).tolist():
                last = _add(last, p)
                colours.append(last)
            steps.append((kind, wide, _bundle_bits(count), colours))
            wide = -(-wide >> _bundle_bits(count))
        else:
            steps.append((kind, wide, 0, None))
    px = _read_pixels(r, wide, height, True)
    for kind, wide, size, side in reversed(steps):
        px = _undo(kind, px, wide, height, size, side)
    return width, height, px


def _undo(kind: int, px: np.ndarray, width: int, height: int, size: int, side: list | None) -> np.ndarray:
    if kind == SUBTRACT_GREEN:
        parts = px.view(np.uint8).reshape(-1, 4).copy()
        parts[:, 0] += parts[:, 1]
        parts[:, 2] += parts[:, 1]
        return parts.reshape(-1).view("<u4")
    if kind == PALETTE:
        held, known = -(-width >> size), np.zeros(256, np.uint32)
        known[: len(side)] = side
        green = (px >> 8 & 255).reshape(height, held)
        bits = 8 >> size
        x = np.arange(width)
        index = green[:, x >> size] >> ((x & ((1 << size) - 1)) * bits).astype(np.uint32) & ((1 << bits) - 1)
        return known[index].reshape(-1)
    if kind == CROSS_COLOUR:
        return _crossed_all(px, side, width, height, size, 1)
    if set((p >> 8 & 15 for p in side)) <= {2}:  # all from the pixel above: sums down the columns
        rows = px.view(np.uint8).reshape(height, width, 4).copy()
        rows[0, :, 3] += 255
        rows[0] = np.cumsum(rows[0], axis=0, dtype=np.uint8)
        rows[0, 1:, 3] -= (255 * np.arange(1, width)).astype(np.uint8)
        return np.cumsum(rows, axis=0, dtype=np.uint8).reshape(-1).view("<u4")
    out, across = px.tolist(), -(-width >> size)
    for y in range(height):
        for x in range(width):
            at, element = y * width + x, side[(y >> size) * across + (x >> size)]
            out[at] = _add(out[at], _guess(out, at, x, y, width, element >> 8 & 15))
    return np.array(out, np.uint32)


def _containers(data: bytes) -> Iterator[bytes]:
    """The VP8L chunks of RIFF files laid end to end."""
    at = 0
    while at < len(data):
        riff, size, form, chunk, held = struct.unpack_from("<4sI4s4sI", data, at)
        if (riff, form, chunk) != (b"RIFF", b"WEBP", b"VP8L"):
            raise ValueError("not a lossless WebP file")
        yield data[at + 20 : at + 20 + held]
        at += 8 + size


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, argb as uint32) of each image."""
    return [_read_image(x) for x in _containers(data)]


# --- writing -------------------------------------------------------------------------------------


def _spread(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits of all values (of so many bits each, 64 at most), the lowest first."""
    keep = size.nonzero()[0]
    if not len(keep):
        return np.empty(0, np.uint8)
    value, size = value[keep], size[keep]
    begins = size.cumsum()
    total = int(begins[-1])
    begins -= size
    word, shift = begins >> 6, (begins & 63).view(np.uint64)
    first = np.zeros(int(word[-1]) + 1, np.int64)  # each word but the last has a value that begins in it
    change = (word[1:] != word[:-1]).nonzero()[0]
    first[1:] = change + 1
    last = np.empty_like(first)  # and only the last one of them goes on in the next word
    last[:-1], last[-1] = change, len(word) - 1
    held = np.zeros(len(first) + 1, np.uint64)
    held[:-1] = np.bitwise_or.reduceat(value << shift, first)
    held[1:] |= value[last] >> np.uint64(1) >> np.uint64(63) - shift[last]
    return np.unpackbits(held.view(np.uint8), count=total, bitorder="little")


class _Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.value = self.size = 0  # bits that are not in parts yet

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits
        if self.size > 8192:
            self.flush()

    def flush(self) -> None:
        if self.size:
            raw = np.frombuffer(self.value.to_bytes(self.size + 7 >> 3, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, count=self.size, bitorder="little"))
            self.value = self.size = 0

    def array(self, bits: np.ndarray) -> None:
        self.flush()
        self.parts.append(bits)

    def add(self, other: _Writer) -> None:
        """All that another one holds."""
        for part in other.parts:
            self.array(part)
        self.put(other.value, other.size)

    def file(self) -> bytes:
        self.flush()
        body = np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()
        padded = body + b"\0" * (len(body) & 1)
        return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(padded), b"WEBP", b"VP8L", len(body)) + padded


def _write_lengths(w: _Writer, lengths) -> None:
    """A prefix code: the simple form for one or two bytes, else each length by a code of its own."""
    lengths = np.asarray(lengths)
    used = lengths.nonzero()[0].tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1 | (len(used) - 1) << 1 | 4, 3)
        for s in used:
            w.put(s, 8)
        return
    w.put(0, 1)
    kinds = np.unique(lengths).tolist()
    size = max(1, (len(kinds) - 1).bit_length())
    short = (1 << size) - len(kinds)  # so many words are one bit shorter, and the code is complete
    outer = [0] * 19
    for n, kind in enumerate(kinds):
        outer[kind] = (size - 1 if n < short else size) if len(kinds) > 1 else 1
    last = max(n for n, kind in enumerate(CODE_LENGTH_ORDER) if outer[kind])
    w.put(max(0, last - 3), 4)
    for kind in CODE_LENGTH_ORDER[: max(4, last + 1)]:
        w.put(outer[kind], 3)
    w.put(0, 1)
    if len(kinds) == 2:
        w.array((lengths == kinds[1]).astype(np.uint8))
    elif len(kinds) > 2:
        words = _canonical(outer)
        for n in lengths.tolist():
            w.put(*words[n])


@lru_cache(maxsize=4096)
def _even_header(present: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """For an alphabet of bytes (packed flags): the bits that announce its codes, each byte's word, left
    aligned, and the length of the words. Unused bytes fill the alphabet up to a power of two."""
    flags = np.unpackbits(np.frombuffer(present, np.uint8)).astype(bool)
    bits = max(0, int(flags.sum()) - 1).bit_length()
    flags[np.flatnonzero(~flags)[: (1 << bits) - int(flags.sum())]] = True
    w = _Writer()
    w.put(0, 2)  # neither colour cache nor meta prefix codes
    lengths = np.zeros(280, np.int64)
    lengths[:256][flags] = max(bits, 1)
    for alphabet in (280, 256, 256, 256):
        _write_lengths(w, lengths[:alphabet])
    _write_lengths(w, [1] + [0] * 39)
    w.flush()
    words = ((np.cumsum(flags) - 1) << (8 - bits)).astype(np.uint8)
    return np.concatenate(w.parts), words, bits


def _write_even(w: _Writer, px: np.ndarray) -> None:
    """Pixels with one code for all channels whose words are equally long; no other feature."""
    raw = px.view(np.uint8)
    header, words, bits = _even_header(np.packbits(np.bincount(raw, minlength=256) > 0).tobytes())
    w.array(header)
    if bits:
        quads = words[raw].reshape(-1, 4)[:, [1, 2, 0, 3]]
        w.array(np.unpackbits(quads.reshape(-1, 1), axis=1, count=bits).reshape(-1))


def _depths(weight: list[int]) -> list[int]:
    """Code lengths of two symbols or more in order of their counts: they and the nodes made of them are two
    queues, of whose heads the two lightest are joined."""
    size, none = len(weight), 1 << 62
    leaves, nodes, parent = [*weight, none], [none] * size, [0] * (2 * size - 1)
    leaf = node = 0
    for new in range(size - 1):
        if (one := leaves[leaf]) <= (other := nodes[node]):
            parent[leaf] = new
            leaf += 1
            total = one
        else:
            parent[size + node] = new
            node += 1
            total = other
        if (one := leaves[leaf]) <= (other := nodes[node]):
            parent[leaf] = new
            leaf += 1
            total += one
        else:
            parent[size + node] = new
            node += 1
            total += other
        nodes[new] = total
    depth = [0] * (size - 1)
    for n in range(size - 3, -1, -1):
        depth[n] = depth[parent[size + n]] + 1
    return [depth[n] + 1 for n in parent[:size]]


def _huffman(counts: list[int]) -> list[int]:
    """Code lengths of at most 15 bits; counts are halved until the lengths fit."""
    lengths = [0] * len(counts)
    while True:
        leaves = sorted([c << 12 | n for n, c in enumerate(counts) if c])  # fewer than 4,096 symbols
        if len(leaves) <= 1:
            for leaf in leaves:
                lengths[leaf & 4095] = 1
            return lengths
        depth = _depths([leaf >> 12 for leaf in leaves])
        if max(depth) <= 15:
            for leaf, d in zip(leaves, depth):
                lengths[leaf & 4095] = d
            return lengths
        counts = [-(-c // 2) for c in counts]


def _write_general(w: _Writer, px: list[int], width: int, top: bool, cache_bits: int, matches: bool, tile: int) -> None:
    """Pixels by Huffman codes, with back-references, a colour cache and two code groups if asked for."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, across = 1, -(-width >> tile) if tile else 0
    if top:
        w.put(bool(tile), 1)
        if tile:
            groups = 2
            w.put(tile - 2, 3)
            down = -(-(len(px) // width) >> tile)
            _write_general(w, [(x + y & 1) << 8 for y in range(down) for x in range(across)], across, False, 0, False, 0)
    group_of = (lambda at: ((at // width >> tile) + (at % width >> tile)) & 1) if groups == 2 else (lambda at: 0)
    short = _short(width)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    seen: dict[tuple, int] = {}
    tokens, at = [], 0
    while at < len(px):
        length, back = 0, 0
        if matches and (before := seen.get(tuple(px[at : at + 3]))) is not None and at + 3 <= len(px):
            while at + length < len(px) and length < 4096 and px[before + length] == px[at + length]:
                length += 1
            back = at - before
        slot = (0x1E35A7BD * px[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache else -1
        if length >= 3:
            tokens.append((group_of(at), "copy", length, short.get(back, back + 120)))
            step = length
        else:
            tokens.append((group_of(at), "cache", slot, 0) if cache and cache[slot] == px[at] else (group_of(at), "pixel", px[at], 0))
            step = 1
        for k in range(at, at + step):
            seen[tuple(px[k : k + 3])] = k
            if cache:
                cache[(0x1E35A7BD * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        at += step
    counts = [[[0] * n for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    written = []
    for group, kind, a, b in tokens:
        if kind == "pixel":
            parts = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, 280 + a, 0, 0)]
        else:
            (s, n, v), (t, m, u) = _prefixed(a), _prefixed(b)
            parts = [(0, 256 + s, n, v), (4, t, m, u)]
        for k, symbol, _, _ in parts:
            counts[group][k][symbol] += 1
        written.append((group, parts))
    codes = []
    for group in counts:
        lengths = [_huffman(c) if any(c) else [1] + [0] * (len(c) - 1) for c in group]
        for n in lengths:
            _write_lengths(w, n)
        codes.append([_canonical(n) for n in lengths])
    for group, parts in written:
        for k, symbol, extra, value in parts:
            w.put(*codes[group][k][symbol])
            w.put(value, extra)


def encode(px: np.ndarray, width: int, transforms: tuple = (), cache_bits: int = 0, matches: bool = False, tile: int = 0) -> bytes:
    """One WebP file of argb pixels (uint32, row by row). Without options: the plain, even form."""
    height = len(px) // width
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    wide, values = width, None
    for kind in transforms:
        values = px.tolist() if values is None else values
        w.put(1, 1)
        w.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            values = [_green(p, -1) for p in values]
        elif kind == PALETTE:
            colours = sorted(set(values))
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(colours) - 1, 8)
            steps = [_sub(c, colours[n - 1] if n else 0) for n, c in enumerate(colours)]
            _write_general(w, steps, len(steps), False, 0, False, 0)
            size, index = _bundle_bits(len(colours)), {c: n for n, c in enumerate(colours)}
            bits, held = 8 >> size, -(-wide >> size)
            packed = [0xFF000000] * (held * height)
            for at, p in enumerate(values):
                x = at % wide
                packed[at // wide * held + (x >> size)] |= index[p] << 8 + bits * (x & ((1 << size) - 1))
            values, wide = packed, held
        else:
            size = 2
            across, down = -(-wide >> size), -(-height >> size)
            side = [(n % 14) << 8 if kind == PREDICTOR else (n * 37 & 0xFFFFFF) for n in range(across * down)]
            w.put(size - 2, 3)
            _write_general(w, side, across, False, 0, False, 0)
            of = lambda at: side[(at // wide >> size) * across + (at % wide >> size)]
            if kind == PREDICTOR:
                values = [_sub(p, _guess(values, at, at % wide, at // wide, wide, of(at) >> 8 & 15)) for at, p in enumerate(values)]
            else:
                values = [_crossed(p, of(at), -1) for at, p in enumerate(values)]
    w.put(0, 1)
    if values is None and not (cache_bits or matches or tile):
        _write_even(w, np.ascontiguousarray(px))
    else:
        _write_general(w, px.tolist() if values is None else values, wide, True, cache_bits, matches, tile)
    return w.file()


# --- the compact form: whole arrays at a time ---------------------------------------------------------

#: The longest word of the codes written here, which keeps the reader's tables small.
LONGEST = 12


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman lengths of at most LONGEST bits."""
    used, lengths = counts.nonzero()[0], np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used[0] if len(used) else 0] = 1
        return lengths
    counts = counts[used]
    while True:
        leaves = np.sort(counts << 12 | used)
        depth = _depths((leaves >> 12).tolist())
        if max(depth) <= LONGEST:
            lengths[leaves & 4095] = depth
            return lengths
        counts = -(-counts // 4)


@lru_cache(maxsize=4096)
def _run_symbols(value: int, run: int, again: bool) -> list[int]:
    """The codes of a run of equal lengths (again: the length before it, zeros apart, is the same), with their
    extra bits above them."""
    symbols = []
    if not value:
        while run >= 3:
            n = min(run, 138)
            symbols.append((n - 11) << 5 | 18 if n >= 11 else (n - 3) << 5 | 17)
            run -= n
    else:
        if not again and run >= 3:
            symbols.append(value)
            run -= 1
        while run >= 3:
            n = min(run, 6)
            symbols.append((n - 3) << 5 | 16)
            run -= n
    return symbols + [value] * run


def _put_lengths(w: _Writer, lengths: np.ndarray) -> None:
    """A prefix code whose lengths are coded in turn, runs of zeros and repeats by the codes 16 to 18."""
    raw = lengths.tobytes()
    if len(raw) - raw.count(0) <= 2 and not any(raw[256:]):
        _write_lengths(w, lengths)
        return
    cut = (lengths[1:] != lengths[:-1]).nonzero()[0].tolist()
    symbols, before, begin = [], 8, 0
    for end in cut:
        value = raw[end]
        end += 1
        if (run := end - begin) < 3:
            symbols.append(value)
            if run == 2:
                symbols.append(value)
        else:
            symbols += _run_symbols(value, run, value == before)
        before, begin = value or before, end
    symbols += _run_symbols(raw[-1], len(raw) - begin, raw[-1] == before)
    counts, often = [0] * 19, Counter(symbols)  # of symbols with their extra bits above them
    for s, n in often.items():
        counts[s & 31] += n
    while max(outer := _huffman(counts)) > 7:
        counts = [-(-c // 2) for c in counts]
    order = [outer[kind] for kind in CODE_LENGTH_ORDER]
    while len(order) > 4 and not order[-1]:
        order.pop()
    head = len(order) - 4 << 1
    for at, n in enumerate(order):
        head |= n << 5 + 3 * at
    w.put(head, 6 + 3 * len(order))
    words = _length_words(bytes(outer))
    spelt = {}  # as digits, the last bit first
    for s in often:
        word, n = words[s & 31]
        if s > 15:
            word |= s >> 5 << n
            n += _EXTRA[s & 31]
        spelt[s] = _DIGITS[n][word] if n < 8 else f"{word:0{n}b}"
    symbols.reverse()
    digits = "".join([spelt[s] for s in symbols])
    w.put(int(digits or "0", 2), len(digits))


#: The numbers of so many bits as digits.
_DIGITS = [[""], *([f"{word:0{n}b}" for word in range(1 << n)] for n in range(1, 8))]

#: The lengths of a code of distances that is never asked.
_LONE = np.array([1] + [0] * 39, np.uint8)

#: Extra bits after each code of a code length.
_EXTRA = [0] * 16 + [2, 3, 7]


@lru_cache(maxsize=64)
def _short(width: int) -> dict[int, int]:
    """The codes of short distances."""
    return {max(1, x + y * width): n + 1 for n, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}


def _copies(px: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance), from left to right: stretches that agree with the last place
    where the same `least` pixels stood."""
    n = len(px) - least + 1
    if n < 2:
        return []
    long = px.astype(np.uint64)
    spread, key = long * np.uint64(0xC2B2AE3D27D4EB4F), long[:n]
    for k in range(1, least):
        key = key * np.uint64(0x9E3779B97F4A7C15)
        key ^= spread[k : n + k]
    # Sorted by the upper bits of the keys, with the place in the lower ones.
    low = np.uint64(n.bit_length())
    key >>= low
    key <<= low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    held = key
    again = ((held[1:] ^ held[:-1]) >> low == 0).nonzero()[0]
    if not len(again):
        return []
    held &= np.uint64((1 << int(low)) - 1)
    order = held.view(np.int64)
    back = np.zeros(n, np.int64)
    at = order[again + 1]
    back[at] = at - order[again]
    at = np.flatnonzero(back)
    # The keys may collide: a copy has to be one.
    from_there = at - back[at]
    alike = px[at] == px[from_there]
    for k in range(1, least):
        alike &= px[at + k] == px[from_there + k]
    at = at[alike]
    if not len(at):
        return []
    far = back[at]
    cut = ((at[1:] - at[:-1] != 1) | (far[1:] != far[:-1])).nonzero()[0]
    begins, ends = [int(at[0]), *at[cut + 1].tolist()], [*at[cut].tolist(), int(at[-1])]
    out, free = [], 0
    for begin, end, distance in zip(begins, ends, [int(far[0]), *far[cut + 1].tolist()]):
        begin, stop = max(begin, free), end + least
        while stop - begin >= least:
            length = min(stop - begin, 4096)
            out.append((begin, length, distance))
            begin = free = begin + length
    return out


def _cached(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot in the colour cache, and whether the cache holds it when it comes."""
    slot = (px * np.uint32(0x1E35A7BD)) >> np.uint32(32 - bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")  # bits is 11 at most; short numbers sort faster
    same = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    hit = np.zeros(len(px), bool)
    hit[order[1:][same]] = True
    return slot.astype(np.int64), hit


def _put_pixels(w: _Writer, px: np.ndarray, width: int, top: bool) -> None:
    """Pixels by Huffman codes; the main image (top) with back-references and a colour cache."""
    copies = _copies(px) if top else []
    alone, free = np.ones(len(px), bool), len(px)
    for begin, length, _ in copies:
        alone[begin : begin + length] = False
        free -= length
    bits = min(10, max(1, free.bit_length() - 3)) if top else 0
    slot, hit = _cached(px, bits) if bits else (None, np.zeros(len(px), bool))
    hit &= alone
    asked = hit.nonzero()[0]
    if not len(asked):
        bits = 0
    w.put(bool(bits) | bits << 1, 5 if bits else 1)
    if top:
        w.put(0, 1)
    alone ^= hit
    plain = alone.nonzero()[0]
    channels = np.empty((4, len(plain)), np.int64)
    for k, channel in zip((2, 0, 1, 3), px[plain].view(np.uint8).reshape(-1, 4).T):
        channels[k] = channel
    greens = np.zeros(280 + (1 << bits if bits else 0), np.int64)
    greens[:256] = np.bincount(channels[0], minlength=256)
    far = None
    if copies:
        short = _short(width)
        lengths = [_prefixed(length) for _, length, _ in copies]
        distances = [_prefixed(short.get(back, back + 120)) for _, _, back in copies]
        greens[256:280] = np.bincount([s for s, _, _ in lengths], minlength=24)
        far = np.bincount([s for s, _, _ in distances], minlength=40)
    if bits:
        of = slot[asked]
        greens[280:] = np.bincount(of, minlength=1 << bits)
    pooled = np.bincount(channels[1:].reshape(-1), minlength=256)  # red, blue and alpha are alike in bytes of text
    codes = []
    for held, times in ((greens, 1), (pooled, 3), (far, 1))[: 3 if copies else 2]:
        found = _code_lengths(held)
        own = _Writer()
        _put_lengths(own, found)
        for _ in range(times):
            w.add(own)
        codes.append(_words(found))
    if not copies:
        _put_lengths(w, _LONE)
    # One entry a token: what it writes (64 bits at most) and how many bits that is.
    value, size = np.zeros(len(px), np.uint64), np.zeros(len(px), np.int64)
    found, others = codes[0].take(channels[0]), codes[1].take(channels[1:])
    whole, at = found & 0xFFFF, found >> 16
    words, sizes = others & 0xFFFF, others >> 16
    for k in range(3):
        whole |= words[k] << at
        at += sizes[k]
    value[plain], size[plain] = whole.view(np.uint64), at
    if bits:
        found = codes[0][280:].take(of)
        value[asked], size[asked] = found & 0xFFFF, found >> 16
    if copies:
        starts, ends = codes[0][256:280].tolist(), codes[2].tolist()
        for (begin, _, _), (s, n, v), (t, m, u) in zip(copies, lengths, distances):
            whole = at = 0
            for part, count in ((starts[s] & 0xFFFF, starts[s] >> 16), (v, n), (ends[t] & 0xFFFF, ends[t] >> 16), (u, m)):
                whole |= part << at
                at += count
            value[begin], size[begin] = whole, at
    w.array(_spread(value, size))


@lru_cache(maxsize=1)
def _weighed(most: int) -> np.ndarray:
    """n * log2(n) for n up to the most pixels, less the share of a symbol that occurs."""
    n = np.arange(most + 1, dtype=np.float64)
    return n * np.log2(np.maximum(n, 1)) - 6.0 * (n > 0)


def _bits_of(planes: np.ndarray) -> np.ndarray:
    """For each row of bytes the bits that they take by their entropy, with a share for each symbol of the code."""
    k, n = planes.shape
    counts = np.bincount(np.add(planes, _ROWS[:k], dtype=np.int64).reshape(-1), minlength=256 * k).reshape(k, 256)
    weighed = _weighed(max(n, WIDTH * MAX_HEIGHT))
    return weighed[n] + 6.0 - np.add.reduce(weighed.take(counts), axis=1)


_ROWS = np.arange(0, 256 * 12, 256)[:, None]


def _slopes(px: np.ndarray) -> int:
    """The cross-colour element of an image: slopes of red and blue over green, in 32nds."""
    held = px.view(np.int8).reshape(-1, 4).T.astype(np.float64)  # blue, green, red, alpha; the sums are whole numbers
    total, by_green = np.add.reduce(held, axis=1).tolist(), (held @ held[1]).tolist()
    blue, green, red = (by_green[k] - total[k] * total[1] / len(px) for k in range(3))
    slope = lambda y: max(-127, min(127, round(32 * y / max(1e-9, green)))) & 255
    return slope(red) | slope(blue) << 8


def compact(px: np.ndarray, width: int) -> bytes:
    """One WebP file of argb pixels by the transform that leaves the least entropy, if any."""
    px = np.ascontiguousarray(px, np.uint32)
    height = len(px) // width
    element = _slopes(px)
    # The channels as they are, all less the pixel before (the one above), blue and red less green, and less what they have of it.
    planes = np.empty((12, len(px)), np.uint8)
    planes[:4] = planes[4:8] = px.view(np.uint8).reshape(-1, 4).T
    blue, green, red = planes[:3]
    above = planes[4:8]
    above[:, width:] -= planes[:4, :-width]
    above[:, 1:width] -= planes[:4, : width - 1]
    above[3, :1] -= 255
    np.subtract(blue, green, out=planes[8])
    np.subtract(red, green, out=planes[9])
    np.subtract(blue, _share(element >> 8 & 255).take(green), out=planes[10])
    np.subtract(red, _share(element & 255).take(green), out=planes[11])
    bits = _bits_of(planes).tolist()
    costs = {(): sum(bits[:4]), (PREDICTOR,): sum(bits[4:8]) + 40, (SUBTRACT_GREEN,): bits[8] + bits[1] + bits[9] + bits[3] + 40}
    if element:
        costs[(CROSS_COLOUR,)] = bits[10] + bits[1] + bits[11] + bits[3] + 40
    head = np.sort(px[:1024])
    colours = head[1:][head[1:] != head[:-1]]  # but the least
    if len(colours) < 256 and len(colours := np.unique(px) if len(px) > 1024 else np.append(head[:1], colours)) <= 256:
        steps = np.concatenate([colours[:1], _less(colours[1:], colours[:-1])])
        index = np.searchsorted(colours, px)
        counts = np.bincount(index)
        costs[(PALETTE,)] = float((counts * (np.log2(len(px)) - np.log2(counts))).sum()) + 6.0 * len(colours) + float(_bits_of(steps.view(np.uint8).reshape(-1, 4).T).sum()) + 48
    kinds = min(costs, key=lambda k: (costs[k], k))
    w = _Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    held, wide = px, width
    if kinds == (PREDICTOR,):
        held = np.ascontiguousarray(above.T).reshape(-1).view("<u4")
    elif kinds == (SUBTRACT_GREEN,):
        held = np.ascontiguousarray(planes[[8, 1, 9, 3]].T).reshape(-1).view("<u4")
    elif kinds == (CROSS_COLOUR,):
        held = _crossed_all(px, [element], width, height, 14, -1)
    for kind in kinds:
        w.put(1 | kind << 1, 3)
        if kind == PALETTE:
            w.put(len(colours) - 1, 8)
            _put_pixels(w, steps, len(colours), False)
            size = _bundle_bits(len(colours))
            wide = -(-width >> size)
            shift = np.tile((8 >> size) * (np.arange(width) & ((1 << size) - 1)), height)
            green = np.zeros(wide * height, np.int64)
            np.bitwise_or.at(green, np.repeat(np.arange(height), width) * wide + np.tile(np.arange(width) >> size, height), index << shift)
            held = (np.uint32(0xFF000000) | green.astype(np.uint32) << np.uint32(8)).astype(np.uint32)
        elif kind in (PREDICTOR, CROSS_COLOUR):
            # tiles of 512 pixels, all alike: from above, or the one element
            w.put(7, 3)
            count = (-(-wide >> 9)) * (-(-height >> 9))
            _put_pixels(w, np.full(count, 2 << 8 if kind == PREDICTOR else element, np.uint32), -(-wide >> 9), False)
    w.put(0, 1)
    _put_pixels(w, held, wide, True)
    return w.file()


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b, channel by channel."""
    return (a.view(np.uint8) - b.view(np.uint8)).view("<u4")


# --- columns ---------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def store(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as WebP files."""
    px, most = np.frombuffer(payload, "<u4"), WIDTH * MAX_HEIGHT
    return b"".join(compact(px[at : at + most], WIDTH) for at in range(0, len(px), most))


def load(media: bytes) -> bytes:
    return b"".join(px.astype("<u4", copy=False).tobytes() for _, _, px in decode(media))


def feature(payload: bytes) -> str:
    """Sixteen column means of the pixel rows and the share of each of 16 value bands, in hex."""
    rows = np.frombuffer(payload, np.uint8)
    means = (np.add.reduce(rows.reshape(-1, 16), axis=0, dtype=np.int64) // (len(rows) >> 4)).astype(np.uint8)
    bands = np.bincount(rows >> 4, minlength=16) * 255 // len(rows)
    return means.tobytes().hex() + bands.astype(np.uint8).tobytes().hex()


COLUMNS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False, text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and describe what was read; `media` holds the files if kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                media = store(padded(data))
                back = load(media)
                row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))
                out.append((*row, media) if keep_media else row)
            names = [c.split()[0] for c in COLUMNS.split(", ")] + ["media"] * keep_media
            yield pd.DataFrame(out, columns=names)

    found = docs.select(whole_id(), F.col(text_col).alias("text")).mapInPandas(run, COLUMNS + ", media binary" * keep_media)
    return null_ids(found)
