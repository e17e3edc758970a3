"""Progressive JPEG columns: bytes as quantised coefficients, read back from scans.

A payload of 64-byte blocks becomes the coefficient blocks of a 4:2:0 image in
progressive JPEG: spectral selection and successive approximation, one component
a scan, with restart intervals.  Decoding accumulates the scans into coefficient
arrays; all restart intervals of a batch are decoded in step, so that numpy does
the work, not a loop over symbols.  The coefficients give the payload back
exactly, and, inverse-transformed and with upsampled chroma, a full-resolution
RGB tensor.  All work is per document: nothing is shuffled.

The reader also takes progressive files of other writers: interleaved DC scans,
quantisation tables, other sampling, any sides, one component or three.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .shared import tidy, with_columns
from .textkit import slices, utf8

#: Blocks in a restart interval.
INTERVAL = 8
#: Most MCUs on the long side of an image.
SIDE = 4095
#: (first coefficient, last, high bit, low bit) of each component's scans.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))

_DC_SYMBOLS = list(range(12))
_AC_SHORT = [0x00, *range(1, 9)]
_AC_LONG = [s for s in range(256) if s not in _AC_SHORT and (s & 15) <= 10]
_U = np.uint64


def _codes(groups: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes and lengths by symbol, and the table as DHT has it."""
    code, length, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    counts, symbols = [0] * 16, []
    for bits, members in groups:
        at <<= bits - last
        last = bits
        for s in members:
            code[s], length[s] = at, bits
            at += 1
        counts[bits - 1] = len(members)
        symbols += members
    return code, length, bytes(counts + symbols)


DC_CODE, DC_LEN, DC_TABLE = _codes([(4, _DC_SYMBOLS)])
AC_CODE, AC_LEN, AC_TABLE = _codes([(4, _AC_SHORT), (10, _AC_LONG)])


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((u + v, v if (u + v) % 2 else u, u * 8 + v) for u in range(8) for v in range(8)), key=lambda c: (c[0], c[2] if c[0] % 2 else -c[2]))
    return np.array([c[2] for c in cells])


def _basis() -> np.ndarray:
    """Pixels (64) from coefficients in zigzag order (64), times 1024, as whole numbers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    full = np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)
    return np.rint(full[zigzag()] * 1024)


ZIGZAG, BASIS = zigzag(), _basis()


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x + 1)).astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, v + (1 << size) - 1)


def _pack_bits(value: np.ndarray, bits: np.ndarray, seg: np.ndarray, n_segs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones to whole bytes, and the segments' offsets."""
    total = np.bincount(seg, weights=bits, minlength=n_segs).astype(np.int64)
    size = (total + 7) >> 3
    start = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(bits) - bits
    first = np.concatenate([[0], np.cumsum(total)])
    at = start[seg] * 8 + before - first[seg]
    word, room = at >> 6, 64 - (at & 63) - bits
    v = value.astype(_U)
    high = np.where(room >= 0, v << np.maximum(room, 0).astype(_U), v >> np.maximum(-room, 0).astype(_U))
    words = np.zeros((start[-1] >> 3) + 2, _U)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.add.reduceat(high, heads)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] += v[over] << (64 + room[over]).astype(_U)
    out = words.astype(">u8").view(np.uint8)[: start[-1]].copy()
    pad = size * 8 - total
    out[start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return out, start


def _dc_items(c: np.ndarray, first: np.ndarray, high: int, low: int):
    """One item a block; first: blocks that begin a restart interval."""
    if high:
        return (c[:, 0] >> low) & 1, np.ones(len(c), np.int64), np.arange(len(c))
    v = c[:, 0].astype(np.int64) >> low
    diff = v - np.where(first, 0, np.concatenate([[0], v[:-1]]))
    size = _bit_length(np.abs(diff))
    return (DC_CODE[size] << size) | _extra(diff, size) * (size > 0), DC_LEN[size] + size, np.arange(len(c))


def _merge(parts):
    """Items of several kinds in the order of their keys (each kind is in order)."""
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key, kind="stable")
    return [np.concatenate([p[i] for p in parts])[order] for i in (1, 2, 3)]


_V = np.arange(-1023, 1024)
_V_SIZE = _bit_length(np.abs(_V))
#: Code and value bits of a coefficient that follows no zero, and how many, by value + 1023.
_NEXT = (AC_CODE[_V_SIZE] << _V_SIZE) | _extra(_V, _V_SIZE) * (_V != 0)
_NEXT_BITS = AC_LEN[_V_SIZE] + _V_SIZE


def _grouped(value: np.ndarray, bits: np.ndarray, per: int):
    """Items of `per` neighbours each (60 bits at most) from rows of small ones."""
    n, width = value.shape
    fill = -width % per
    value, bits = (np.pad(x, ((0, 0), (0, fill))).reshape(n, -1, per) for x in (value, bits))
    out = value[:, :, 0]
    for j in range(1, per):
        out = (out << bits[:, :, j]) | value[:, :, j]
    return out, bits.sum(axis=2)


def _rows_first(full: np.ndarray, dense, sparse):
    """Items of whole rows and of the others in the order of rows. dense: (value, bits) by row; sparse: from _merge, by place in the others."""
    value, bits = dense
    whole, others = np.flatnonzero(full), np.flatnonzero(~full)
    row = np.repeat(whole, value.shape[1])
    if sparse is None:
        return value.ravel(), bits.ravel(), row
    rows = np.concatenate([row, others[sparse[2]]])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([value.ravel(), sparse[0]])[order], np.concatenate([bits.ravel(), sparse[1]])[order], rows[order]


def _ac_items(c: np.ndarray, lo: int, hi: int, low: int):
    a = c[:, lo : hi + 1]
    v = np.sign(a) * (np.abs(a) >> low)
    full = (v != 0).all(axis=1)
    i = v[full].astype(np.int64) + 1023
    return _rows_first(full, _grouped(_NEXT[i], _NEXT_BITS[i], 4), None if full.all() else _ac_sparse(c[~full], lo, hi, low))


def _ac_sparse(c: np.ndarray, lo: int, hi: int, low: int):
    a = c[:, lo : hi + 1].astype(np.int64)
    v = np.sign(a) * (np.abs(a) >> low)
    b, k = np.nonzero(v)
    x = v[b, k]
    fresh = np.diff(b, prepend=-1) != 0
    run = np.where(fresh, k, k - np.concatenate([[0], k[:-1]]) - 1)
    size = _bit_length(np.abs(x))
    zrl = run >> 4
    value = np.zeros(len(x), np.int64)
    for _ in range(3):
        more = zrl > 0
        value = np.where(more, (value << AC_LEN[0xF0]) | AC_CODE[0xF0], value)
        zrl -= more
    sym = ((run & 15) << 4) | size
    value = (((value << AC_LEN[sym]) | AC_CODE[sym]) << size) | _extra(x, size)
    bits = (run >> 4) * AC_LEN[0xF0] + AC_LEN[sym] + size
    last = np.full(len(c), -1)
    last[b] = k
    ended = np.flatnonzero(last < hi - lo)
    eob = np.zeros(len(ended), np.int64)
    return _merge([(b * 64 + k, value, bits, b), (ended * 64 + 63, eob + AC_CODE[0], eob + AC_LEN[0], ended)])


def _refine_items(c: np.ndarray, lo: int, hi: int, low: int):
    a = np.abs(c[:, lo : hi + 1]) >> low
    full = (a > 1).all(axis=1)  # corrections only, after the end of the block
    bit = np.concatenate([np.full((int(full.sum()), 1), AC_CODE[0]), a[full] & 1], axis=1).astype(np.int64)
    size = np.ones_like(bit)
    size[:, 0] = AC_LEN[0]
    return _rows_first(full, _grouped(bit, size, 32), None if full.all() else _refine_sparse(c[~full], lo, hi, low))


def _refine_sparse(c: np.ndarray, lo: int, hi: int, low: int):
    a = np.abs(c[:, lo : hi + 1].astype(np.int64)) >> low
    n, width = a.shape
    hb, hk = np.nonzero(a > 1)
    corrections = ((hb * 64 + hk) * 2 + 1, a[hb, hk] & 1, np.ones(len(hb), np.int64), hb)
    nb, nk = np.nonzero(a == 1)
    zeros = np.flatnonzero(a.ravel() == 0)  # places of what stays zero
    fresh = np.diff(nb, prepend=-1) != 0
    prev = np.where(fresh, 0, np.concatenate([[0], nk[:-1] + 1]))
    z0 = np.searchsorted(zeros, nb * width + prev)
    run = np.searchsorted(zeros, nb * width + nk) - z0
    start, parts = prev.copy(), [corrections]
    for j in range(3):
        more = np.flatnonzero(run >= 16 * (j + 1))
        full = np.full(len(more), 0, np.int64)
        parts.append(((nb[more] * 64 + start[more]) * 2, full + AC_CODE[0xF0], full + AC_LEN[0xF0], nb[more]))
        start[more] = zeros[z0[more] + 16 * (j + 1) - 1] - nb[more] * width + 1
    sym = ((run & 15) << 4) | 1
    sign = (c[nb, nk + lo] > 0).astype(np.int64)
    parts.append(((nb * 64 + start) * 2, (AC_CODE[sym] << 1) | sign, AC_LEN[sym] + 1, nb))
    last = np.full(n, -1)
    last[nb] = nk
    ended = np.flatnonzero(last < width - 1)
    eob = np.zeros(len(ended), np.int64)
    parts.append(((ended * 64 + last[ended] + 1) * 2, eob + AC_CODE[0], eob + AC_LEN[0], ended))
    return _merge(parts)


def _entropy(c: np.ndarray, run_rows: np.ndarray, scan: tuple[int, int, int, int]) -> tuple[bytes, np.ndarray]:
    """Stuffed data of one scan for each run of blocks, with restart markers, and the runs' offsets."""
    lo, hi, high, low = scan
    sizes = np.diff(run_rows)
    in_run = np.arange(len(c)) - np.repeat(run_rows[:-1], sizes)
    first = in_run % INTERVAL == 0
    seg_of_block = np.cumsum(first) - 1
    value, bits, block = _dc_items(c, first, high, low) if lo == 0 else _refine_items(c, lo, hi, low) if high else _ac_items(c, lo, hi, low)
    n_segs = int(seg_of_block[-1]) + 1
    data, start = _pack_bits(value, bits, seg_of_block[block], n_segs)
    number = in_run[first] // INTERVAL
    ends_run = np.append(number[1:] == 0, True)
    full = data == 0xFF
    shift = np.cumsum(full) - full
    marks = np.cumsum(~ends_run) - ~ends_run  # markers before each segment
    place = np.arange(len(data)) + shift + 2 * np.repeat(marks, np.diff(start))
    out = np.zeros(len(data) + int(full.sum()) + 2 * int((~ends_run).sum()), np.uint8)
    out[place] = data
    seg_end = place[start[1:] - 1] + 1 + full[start[1:] - 1]
    at = seg_end[~ends_run]
    out[at], out[at + 1] = 0xFF, 0xD0 + (number[~ends_run] & 7)
    return out.tobytes(), np.concatenate([[0], seg_end[ends_run]])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks."""
    mcus = -(-blocks // 6)
    across = -(-mcus // SIDE)
    return across, -(-mcus // across)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload of whole 64-byte blocks (one at least)."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    mcus = np.array([w * h for w, h in shapes])
    rows = np.concatenate([[0], np.cumsum(6 * mcus)])
    c = np.zeros((rows[-1], 64), np.int16)
    for p, a in zip(payloads, rows[:-1], strict=True):
        c[a : a + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    runs = np.concatenate([(rows[:-1, None] + mcus[:, None] * np.array([0, 4, 5])).ravel(), rows[-1:]])
    scans = [_entropy(c, runs, s) for s in SCANS]
    tables = _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE) + _segment(0xDD, struct.pack(">H", INTERVAL))
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    heads = [[_segment(0xDA, bytes([1, comp + 1, 0, lo, hi, high << 4 | low])) for comp in range(3)] for lo, hi, high, low in SCANS]
    out = []
    for k, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        pieces = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(p))), quant, _segment(0xC2, frame), tables]
        for (data, at), head in zip(scans, heads, strict=True):
            for comp in range(3):
                pieces += [head[comp], data[at[3 * k + comp] : at[3 * k + comp + 1]]]
        out.append(b"".join([*pieces, b"\xff\xd9"]))
    return out


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits, from a table as DHT has it."""
    out, at, symbols = np.zeros(1 << 16, np.int64), 0, iter(table[16:])
    for bits, n in enumerate(table[:16], 1):
        for _ in range(n):
            span = 1 << (16 - bits)
            out[at : at + span] = bits << 8 | next(symbols)
            at += span
    return out


class _Bits:
    """Places in destuffed data, one for each restart interval, read in step."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.bytes = padded
        b = padded.astype(np.int64)
        n = len(data) + 1
        self.window = b[:n] << 32 | b[1 : n + 1] << 24 | b[2 : n + 2] << 16 | b[3 : n + 3] << 8 | b[4 : n + 4]
        self.at = np.zeros(0, np.int64)

    def peek(self, who: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        p = self.at[who]
        return (self.window[np.minimum(p >> 3, len(self.window) - 1)] >> (8 - (p & 7))) & 0xFFFFFFFF

    def symbol(self, who: np.ndarray, table: np.ndarray):
        """Run, size and the bits that follow the symbol; the place moves past the symbol alone."""
        x = self.peek(who)
        e = table[x >> 16]
        length, s = e >> 8, e & 255
        self.at[who] += length
        return s >> 4, s & 15, (x << length) & 0xFFFFFFFF


def _value(rest: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = rest >> (32 - size)
    return np.where(size == 0, 0, np.where(v >> np.maximum(size - 1, 0), v, v - (1 << size) + 1))


def _read_dc(bits: _Bits, c: np.ndarray, base: np.ndarray, n: np.ndarray, table: np.ndarray, high: int, low: int) -> None:
    pred = np.zeros(len(base), np.int64)
    for k in range(int(n.max(initial=0))):
        who = np.flatnonzero(n > k)
        if high:
            bit = bits.peek(who) >> 31
            bits.at[who] += 1
            c[base[who] + k, 0] |= (bit << low).astype(c.dtype)
        else:
            _, size, rest = bits.symbol(who, table)
            bits.at[who] += size
            pred[who] += _value(rest, size)
            c[base[who] + k, 0] = pred[who] << low


def _joint(table: np.ndarray) -> np.ndarray:
    """By the next 16 bits: length with value bits, run << 5, 1 << 9 where more must be looked at, value << 10."""
    x = np.arange(1 << 16)
    length, run, size = table >> 8, (table >> 4) & 15, table & 15
    more = ((size == 0) & (run < 15)) | (length + size > 16) | (length == 0)
    v = _value(((x << length) & 0xFFFF) << 16, size)
    return np.where(more, 1 << 9, (length + size) | run << 5 | v << 10)


def _read_ac(bits: _Bits, c: np.ndarray, base: np.ndarray, n: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    flat, joint, window = c.reshape(-1), _joint(table), bits.window
    use = np.flatnonzero(n > 0)
    row, end, at, k = base[use] * 64, (base + n)[use] * 64, bits.at[use], np.full(len(use), lo)
    while len(row):
        e = joint[(window[at >> 3] >> (24 - (at & 7))) & 0xFFFF]
        odd = np.flatnonzero(e & (1 << 9))
        if len(odd):
            hard = _Bits.__new__(_Bits)
            hard.window, hard.at = window, at[odd]
            run, size, rest = hard.symbol(np.arange(len(odd)), table)
            eob = (size == 0) & (run < 15)
            at[odd] = hard.at + np.where(eob, run, size)
            put = np.flatnonzero(size > 0)
            flat[row[odd[put]] + k[odd[put]] + run[put]] = _value(rest, size)[put] << low
            k[odd] = np.where(eob, hi + 1, k[odd] + run + 1)
            row[odd] += np.where(eob, ((1 << run) + (rest >> (32 - run)) - 1) * 64, 0)
            good = np.flatnonzero(~(e & (1 << 9)).astype(bool))
            e, r, kk = e[good], row[good], k[good]
            kk += (e >> 5) & 15
            flat[r + kk] = (e >> 10) << low
            at[good] += e & 31
            k[good] = kk + 1
        else:
            k += (e >> 5) & 15
            flat[row + k] = (e >> 10) << low
            at += e & 31
            k += 1
        over = k > hi
        if over.any():
            row += over * 64
            k = np.where(over, lo, k)
            live = row < end
            if not live.all():
                row, end, at, k = row[live], end[live], at[live], k[live]


def _correct(bits: _Bits, flat: np.ndarray, place: np.ndarray, who: np.ndarray, low: int) -> None:
    """One correction bit for each coefficient in place, who has them."""
    bit = bits.peek(who) >> 31
    bits.at[who] += 1
    v = flat[place].astype(np.int64)
    flat[place] = v + np.where((bit == 1) & ((np.abs(v) >> low) & 1 == 0), np.sign(v) << low, 0)


def _read_refine(bits: _Bits, c: np.ndarray, base: np.ndarray, n: np.ndarray, table: np.ndarray, lo: int, hi: int, low: int) -> None:
    flat, m = c.reshape(-1), len(base)
    block, k = np.zeros(m, np.int64), np.full(m, lo)
    ends, zeros, new, need = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m, bool)  # ends: blocks yet to be ended
    cols = np.arange(hi + 1)
    who = np.flatnonzero(n > 0)
    while len(who):
        ask = who[need[who] & (ends[who] == 0)]
        if len(ask):
            run, size, rest = bits.symbol(ask, table)
            eob = (size == 0) & (run < 15)
            ends[ask] = np.where(eob, (1 << run) + (rest >> (32 - run)), 0)
            bits.at[ask] += np.where(eob, run, size)
            zeros[ask], new[ask], need[ask] = run, np.where(size > 0, np.where(rest >> 31, 1, -1) << low, 0), False
        rest_of = who[ends[who] > 0]
        for part in np.array_split(rest_of, max(1, len(rest_of) // 4096)):  # what is left of a block that has ended: corrections only
            if len(part):
                rows = base[part] + block[part]
                easy = (k[part] == lo) & (c[rows, lo : hi + 1] != 0).all(axis=1)
                if easy.any():
                    e, er = part[easy], rows[easy]
                    p = bits.at[e]
                    near = np.unpackbits(bits.bytes[np.minimum((p >> 3)[:, None] + np.arange(9), len(bits.bytes) - 1)], axis=1)
                    bit = np.take_along_axis(near, (p & 7)[:, None] + np.arange(hi + 1 - lo), axis=1)
                    v = c[er, lo : hi + 1]
                    c[er, lo : hi + 1] = v + np.sign(v) * (bit.astype(v.dtype) << low) * ((np.abs(v) >> low) & 1 == 0)
                    bits.at[e] += hi + 1 - lo
                    k[e] = hi + 1
                    ends[e] -= 1
                    need[e] = True
                    part, rows = part[~easy], rows[~easy]
                v = c[rows, : hi + 1].astype(np.int64)
                old = (v != 0) & (cols >= k[part, None])
                rank = np.cumsum(old, axis=1)
                p = bits.at[part, None] + rank - 1
                bit = (bits.bytes[np.minimum(np.maximum(p, 0) >> 3, len(bits.bytes) - 1)] >> (7 - (p & 7)).astype(np.uint8)) & 1
                c[rows, : hi + 1] = v + np.where(old & (bit == 1) & ((np.abs(v) >> low) & 1 == 0), np.sign(v) << low, 0)
                bits.at[part] += rank[:, -1]
                k[part] = hi + 1
                ends[part] -= 1
                need[part] = True
        step = who[(k[who] <= hi) & (ends[who] == 0)]  # one coefficient on the way to a new one
        if len(step):
            place = (base[step] + block[step]) * 64 + k[step]
            old = flat[place] != 0
            if old.any():
                _correct(bits, flat, place[old], step[old], low)
            z = step[~old]
            arrived = zeros[z] == 0
            zeros[z] -= ~arrived
            flat[place[~old][arrived]] = new[z[arrived]]
            need[z[arrived]] = True
            k[step] += 1
        over = who[k[who] > hi]
        if len(over):
            block[over] += 1
            k[over], need[over] = lo, True
            who = who[block[who] < n[who]]


@dataclass
class Part:
    """A component: sampling factors, quantisation table in zigzag order, blocks across and down (whole MCUs), blocks that hold the image."""

    h: int
    v: int
    quant: np.ndarray
    across: int
    down: int
    used: tuple[int, int]
    first: int = 0  # its first block among the image's


@dataclass
class Head:
    """What a file says of its image and scans; a scan: (lo, hi, high, low), components, tables, restart interval, start, end of its data."""

    width: int = 0
    height: int = 0
    parts: list[Part] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)
    payload: int | None = None
    blocks: int = 0

    def frame(self, body: bytes, quants: dict[int, np.ndarray], ids: list[int]) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or n not in (1, 3) or not self.width or not self.height:
            raise ValueError("a progressive JPEG of 8-bit samples with one or three components is needed")
        ids += [body[6 + 3 * k] for k in range(n)]
        factors = [(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n)]
        wide, high = max(f[0] for f in factors), max(f[1] for f in factors)
        across, down = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        for k, (h, v) in enumerate(factors):
            if wide % h or high % v:
                raise ValueError("sampling factors must divide the largest one")
            used = -(-(-(-self.width * h // wide)) // 8), -(-(-(-self.height * v // high)) // 8)
            self.parts.append(Part(h, v, quants.get(body[8 + 3 * k], np.ones(64, np.int64)), across * h, down * v, used, self.blocks))
            self.blocks += across * h * down * v

    def order(self, members: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The image's blocks in the order of a scan of these components, and the component of each in an MCU."""
        if len(members) == 1:
            p = self.parts[members[0]]
            return (p.first + np.arange(p.used[1])[:, None] * p.across + np.arange(p.used[0])).ravel(), np.zeros(1, np.int64)
        out = []
        for k in members:
            p = self.parts[k]
            y, x = np.arange(p.down // p.v), np.arange(p.across // p.h)
            inner = np.arange(p.v)[:, None] * p.across + np.arange(p.h)
            out.append((p.first + (y[:, None] * p.v * p.across + x * p.h).ravel()[:, None] + inner.ravel()))
        return np.concatenate(out, axis=1).ravel(), np.concatenate([np.full(self.parts[k].h * self.parts[k].v, i) for i, k in enumerate(members)])


def _parse(image: bytes, offset: int, marks: list[int]) -> Head:
    """Headers of one image and its scans; places count from the batch's start."""
    head, at, tables, quants, ids, interval = Head(), 2, {}, {}, [], 0
    while at + 2 <= len(image):
        if image[at] != 0xFF or image[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker = image[at + 1]
        if marker == 0xD9:
            break
        length = int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE and len(body) == 8:
            head.payload = struct.unpack(">Q", body)[0]
        elif marker == 0xDB:
            while body:
                size = 64 * (1 + (body[0] >> 4))
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if body[0] >> 4 else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC2:
            head.frame(body, quants, ids)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            n, (lo, hi, both) = body[0], body[-3:]
            members = tuple(ids.index(body[1 + 2 * k]) for k in range(n))
            used = tuple(tables.get(body[2 + 2 * k] >> 4 if lo == 0 else 0x10 | body[2 + 2 * k] & 15, b"") for k in range(n))
            end = marks[bisect_left(marks, offset + at)] - offset
            head.scans.append(((lo, hi, both >> 4, both & 15), members, used, interval, offset + at, offset + end))
            at = end
    if not head.parts:
        raise ValueError("not a progressive JPEG")
    if head.payload is not None and head.payload > 64 * head.blocks:
        head.payload = None
    return head


def _read_dc_mixed(bits: _Bits, c: np.ndarray, base: np.ndarray, n: np.ndarray, tables: list[np.ndarray], pattern: np.ndarray, low: int) -> None:
    """First DC scan of several components: blocks of an MCU follow pattern, each component with its table and prediction."""
    pred = np.zeros((len(tables), len(base)), np.int64)
    for k in range(int(n.max(initial=0))):
        who, part = np.flatnonzero(n > k), pattern[k % len(pattern)]
        _, size, rest = bits.symbol(who, tables[part])
        bits.at[who] += size
        pred[part, who] += _value(rest, size)
        c[base[who] + k, 0] = pred[part, who] << low


def read_coefficients(images: list[bytes]) -> tuple[list[Head], np.ndarray, np.ndarray]:
    """Headers, coefficient blocks in zigzag order (component by component, image by image), and the images' first blocks.

    The restart intervals of all images' scans are read in step; files without them are read symbol by symbol.
    """
    raw = np.frombuffer(b"".join(images), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in images])])
    full = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[full + 1]
    restart = (following >= 0xD0) & (following <= 0xD7)
    marks = [*full[(following != 0) & (following != 0xFF) & ~restart].tolist(), len(raw)]
    heads = [_parse(x, int(a), marks) for x, a in zip(images, offsets, strict=False)]
    rows = np.concatenate([[0], np.cumsum([h.blocks for h in heads])]).astype(np.int64)
    c = np.zeros((rows[-1], 64), np.int16)
    keep = np.ones(len(raw), bool)
    keep[full[following == 0] + 1] = False
    moved = np.cumsum(keep) - keep
    bits, restarts = _Bits(raw[keep]), full[restart]
    by_scan: dict[tuple, list] = {}
    for k, head in enumerate(heads):
        stage, seen = 0, set()
        for scan, members, tables, interval, a, b in head.scans:
            if seen & set(members) or (seen and len(members) > 1):  # scans of different components may be read in step
                stage, seen = stage + 1, set()
            seen |= set(members)
            p = head.parts[members[0]]
            whole = len(members) == 1 and p.used == (p.across, p.down)
            if whole:
                by_scan.setdefault((stage, scan, tables, interval, True, (0,)), []).append((a, b, rows[k] + p.first, p.across * p.down))
            else:
                blocks, pattern = head.order(members)
                by_scan.setdefault((stage, scan, tables, interval, False, tuple(pattern.tolist())), []).append((a, b, rows[k] + blocks, len(blocks)))
    for (_, (lo, hi, high, low), tables, interval, whole, pattern), found in sorted(by_scan.items(), key=lambda x: x[0][0]):
        a, b, n = (np.array([x[i] for x in found]) for i in (0, 1, 3))
        if whole:
            place, base, into = None, np.array([x[2] for x in found]), c
        else:
            place = np.concatenate([x[2] for x in found])
            base, into = np.cumsum(n) - n, c[place]
        i, j = np.searchsorted(restarts, a), np.searchsorted(restarts, b)
        per = j - i + 1
        run = np.repeat(np.arange(len(a)), per)
        number = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
        start = np.where(number == 0, a[run], restarts[np.minimum(i[run] + number - 1, max(len(restarts) - 1, 0))] + 2 if len(restarts) else a[run])
        step = interval * len(pattern) or int(n.max())
        bits.at = moved[np.minimum(start, len(moved) - 1)] * 8
        blocks, first = np.clip(n[run] - number * step, 0, step), base[run] + number * step
        symbols = [_lookup(t) if t else np.zeros(1 << 16, np.int64) for t in tables]
        if lo == 0 and (high or len(tables) == 1):
            _read_dc(bits, into, first, blocks, symbols[0], high, low)
        elif lo == 0:
            _read_dc_mixed(bits, into, first, blocks, symbols, np.array(pattern), low)
        elif high:
            _read_refine(bits, into, first, blocks, symbols[0], lo, hi, low)
        else:
            _read_ac(bits, into, first, blocks, symbols[0], lo, hi, low)
        if place is not None:
            c[place] = into
    return heads, c, rows


def payload_of(head: Head, blocks: np.ndarray) -> bytes | None:
    """What encode_payloads() was given; None for files of other writers."""
    return None if head.payload is None else (blocks[: head.payload // 64] + 128).astype(np.uint8).tobytes()


def pixels(c: np.ndarray) -> np.ndarray:
    """8x8 samples of each block, level shift not added. Whole numbers, the same in any batch: no sum leaves the exact range."""
    kind = np.float32 if int(np.abs(c).max(initial=0)) <= 512 else np.float64
    return ((c.astype(kind) @ BASIS.astype(kind)).astype(np.int32) + 512) >> 10


def samples(heads: list[Head], c: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """pixels() of all images' blocks, coefficients multiplied by the files' quantisation tables."""
    if all((p.quant == 1).all() for h in heads for p in h.parts):
        return pixels(c)
    c = c.astype(np.int32)
    for head, at in zip(heads, rows, strict=False):
        for p in head.parts:
            part = slice(at + p.first, at + p.first + p.across * p.down)
            c[part] *= p.quant.astype(np.int32)
    return pixels(c)


def rgb(head: Head, px: np.ndarray) -> np.ndarray:
    """A tensor of height x width x 3 from an image's blocks of samples; components with fewer samples are repeated."""
    wide, high = max(p.h for p in head.parts), max(p.v for p in head.parts)
    planes = []
    for p in head.parts:
        x = px[p.first : p.first + p.across * p.down].reshape(p.down, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.down, 8 * p.across)
        planes.append(x.repeat(high // p.v, axis=0).repeat(wide // p.h, axis=1)[: head.height, : head.width])
    y = (planes[0] + 128) << 16
    cb, cr = planes[1:] if len(planes) == 3 else (0, 0)
    out = np.empty((*y.shape, 3), np.uint8)
    for i, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):  # the usual weights times 2**16
        out[:, :, i] = np.clip((v + 32768) >> 16, 0, 255)
    return out


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            data, offsets = utf8(batch["text"].slice(a, b - a))
            whole = data.tobytes()
            payloads = []
            for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payloads.append(whole[p:q] + bytes((-(q - p)) % 64 if q > p else 64))
            yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), batch["n_bytes"].slice(a, b - a), pa.array(encode_payloads(payloads), pa.binary())], ["id", "n_bytes", "media"])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes and `media` of each row: the text's UTF-8 bytes, filled up with 0 to whole blocks of 64, as progressive JPEG.

    Null and empty texts give one block of zeros.  Repeated rows are encoded each; ids may be null or of any type;
    an empty table gives an empty result; other columns are not looked at.  A text is held whole by one task, at some
    fifty times its bytes.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"))
    return plain.mapInArrow(tidy(_encoder), f"id {plain.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


READ = StructType([StructField(*x) for x in (("payload", BinaryType()), ("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("feature", StringType()), ("height", IntegerType()), ("width", IntegerType()), ("rgb", BinaryType()))])


def _read(images: list[bytes | None]) -> list[tuple]:
    """The values of READ for each image; nulls for null."""
    there = [x for x in images if x is not None]
    heads, c, rows = read_coefficients(there)
    px, out = samples(heads, c, rows), []
    for head, p, q in zip(heads, rows[:-1], rows[1:], strict=True):
        image = rgb(head, px[p:q])
        sums = image.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
        payload = payload_of(head, c[p:q])
        own = (None,) * 4 if payload is None else (payload, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        out.append((*own, f"{image.shape[1]}x{image.shape[0]}:{sums[0]},{sums[1]},{sums[2]}", image.shape[0], image.shape[1], image.tobytes()))
    found = iter(out)
    return [(None,) * len(READ) if x is None else next(found) for x in images]


def decode(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """media with what its progressive JPEGs hold: height, width and rgb, the full-resolution tensor's bytes (rows of
    pixels of three 8-bit samples), and feature (size and channel sums); of files of encode() also payload,
    payload_bytes, payload_sha256 and tail_crc32, null for others.

    New columns take the place of those of their names; other columns stay, whatever their names.  Null gives nulls,
    repeated rows are decoded each, an empty table stays empty.  What is no progressive JPEG of 8-bit samples with
    one or three components ends the job with a ValueError.
    """

    def decoded(inside):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch[inside(media_col)], 1 << 20):
                    part = batch.slice(a, b - a)
                    cols = list(zip(*_read(part[inside(media_col)].to_pylist()), strict=True))
                    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], [*part.schema.names, *[f"+{f.name}" for f in READ]])

        return run

    return with_columns(media, decoded, READ)


def report(docs: DataFrame) -> DataFrame:
    """Query op4: digests of the payload that comes back, of the stored form and of the tensor column; a row for each row of docs."""
    read = decode(encode(docs))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"))
