"""FLAC columns: 8-bit mono streams made from bytes; any FLAC stream decoded block by block with checks.

The encoder cuts a payload into blocks of 1,024 samples (byte - 128), takes for each block the
cheapest of the fixed predictors of order 0 and 1 and a fitted linear predictor of order 2, and
writes its residual in Rice codes, a constant or plain samples where that is shorter, with a seek
point at every ``SEEK_EVERY``-th block.

The decoder takes streams of any encoder: 4 to 24 bits, 1 to 8 channels, left/side, side/right and
mid/side stereo, fixed predictors up to order 4 and linear ones up to order 32, both Rice methods
with escapes, wasted bits, fixed and variable block sizes. It finds frames by their headers, with or
without a seek table, verifies the CRC-8 of the headers, the CRC-16 of the frames and the MD5 of the
samples, and advances ``CHUNK`` blocks together one sample a step, so each step is a few numpy
operations over hundreds of blocks. The query writes the streams as a table in the shared folder,
reads that, and decodes what it read; ``blocks`` gives the PCM blocks, ``samples_at`` seeks.

Defined results: null is an empty payload; an empty stream has no blocks and decodes to no bytes;
a damaged stream raises ``ValueError`` naming what failed; equal payloads give equal streams; a very
long payload is coded ``CHUNK`` blocks at a time, so it takes a few times its own size; columns
named like a new one (``media``, ``payload``, ...) are replaced, others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK = 1024
RATE = 8000
#: Bits of a linear predictor's coefficients, and by how much they are shifted.
PRECISION, SHIFT = 8, 6
#: Payload bytes that are handled together, and blocks that are coded in step.
BATCH_BYTES, CHUNK = 1 << 20, 1024
SEEK_EVERY = 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_BY_DISTANCE: list[np.ndarray] = [CRC16]


def crc16(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[lo:hi] (not empty, back to back or not): a CRC is linear, so it is the
    XOR of what each byte gives at its distance from the end."""
    n = (hi - lo).astype(np.int64)
    longest = int(n.max())
    global _BY_DISTANCE
    if len(_BY_DISTANCE) < longest or isinstance(_BY_DISTANCE, list):
        rows = [CRC16]
        for _ in range(max(longest, BLOCK + 64) - 1):
            t = rows[-1]
            rows.append(((t << 8) & 0xFFFF) ^ CRC16[t >> 8])
        _BY_DISTANCE = np.array(rows, np.uint16)
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(lo, n) + within
    return np.bitwise_xor.reduceat(_BY_DISTANCE[np.repeat(n - 1, n) - within, data[at]], first)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _utf8_number(n: int) -> bytes:
    """FLAC's UTF-8-like coding of a frame number of up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _header(number: int, size: int) -> bytes:
    """A frame's header, with its CRC-8."""
    h = b"\xff\xf8" + bytes([(0xA0 if size == BLOCK else 0x70) | 0x04, 0x02]) + _utf8_number(number)
    if size != BLOCK:
        h += (size - 1).to_bytes(2, "big")
    return h + bytes([crc8(h)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The streams of some payloads."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    blocks = -(-sizes // BLOCK)
    n = int(blocks.sum())
    owner = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(sizes[owner] - number * BLOCK, BLOCK)
    at = np.concatenate([[0], np.cumsum(size)])
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    parts, frames = [], []
    for i in range(0, n, CHUNK):
        j = min(i + CHUNK, n)
        raw, lengths = _encode_blocks(joined[at[i] : at[j]], number[i:j], size[i:j])
        parts.append(raw)
        frames += lengths.tolist()
    raw = b"".join(parts)
    start = np.cumsum([0, *frames]).tolist()
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    return [_stream(p, frames[a:b], size[a:b].tolist(), raw[start[a] : start[b]]) for p, a, b in zip(payloads, first, first[1:], strict=False)]


def _encode_blocks(data: np.ndarray, number: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of blocks that lie one after another in ``data``, joined, and their lengths."""
    n = len(size)
    inside = np.arange(BLOCK) < size[:, None]
    s = np.zeros((n, BLOCK), np.int32)
    s[inside] = data
    s[inside] -= 128

    # residuals of the three predictors, and what they cost about
    f = s.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    limit = (1 << (PRECISION - 1)) - 1
    quant = [np.clip(np.rint(np.where(det > 0, x / safe, 0) * (1 << SHIFT)), -limit, limit).astype(np.int32) for x in (r1 * r0 - r1 * r2, r0 * r2 - r1 * r1)]
    zig = []
    lpc = s.copy()
    lpc[:, 2:] -= (quant[0][:, None] * s[:, 1:-1] + quant[1][:, None] * s[:, :-2]) >> SHIFT
    one = s.copy()
    one[:, 1:] -= s[:, :-1]
    for order, r in ((0, s), (1, one), (2, lpc)):
        z = (r << 1) ^ (r >> 31)
        z[~inside] = 0
        z[:, :order] = 0
        zig.append(z)
    means = np.array([z.sum(1) for z in zig]) / np.maximum(1, size)
    cost = np.log2(means + 1) * size + 8 * np.array([[0], [1], [2]]) + np.array([[0], [0], [9 + 2 * PRECISION]])
    cost[2, size < 3] = cost[1, size < 2] = np.inf
    order = cost.argmin(0)
    z = np.where((order == 0)[:, None], zig[0], np.where((order == 1)[:, None], zig[1], zig[2]))
    mean = z.sum(1) / np.maximum(1, size)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int32)
    k = np.maximum(k, np.ceil(np.log2((z.max(1) + 1) / 24.0)).clip(0)).astype(np.int32)  # quotients stay short
    # of the parameter that the mean suggests and its neighbours the one that takes least bits
    bits_of = np.array([(z >> np.maximum(k + j, 0)[:, None]).sum(1) + np.maximum(k + j, 0) * size for j in (-1, 0, 1)])
    k = np.clip(k + bits_of.argmin(0) - 1, 0, 14).astype(np.int32)
    k = np.maximum(k, np.ceil(np.log2((z.max(1) + 1) / 24.0)).clip(0)).astype(np.int32)
    q = z >> k[:, None]
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    length = np.where(coded, q + 1 + k[:, None], 0)
    fixed = 8 + 8 * order + np.where(order == 2, 9 + 2 * PRECISION, 0) + 10
    rice_bits = fixed + length.sum(1)
    constant = ((s == s[:, :1]) | ~inside).all(1)
    plain = ~constant & (rice_bits >= 8 + 8 * size)
    rice = ~constant & ~plain
    body_bits = np.where(constant, 16, np.where(plain, 8 + 8 * size, rice_bits))

    heads = [_header(a, b) for a, b in zip(number.tolist(), size.tolist(), strict=True)]
    head = np.fromiter(map(len, heads), np.int64, n)
    frame = head + (body_bits + 7) // 8 + 2
    start = np.cumsum(frame) - frame
    bits = np.zeros(8 * int(frame.sum()), np.uint8)
    body = 8 * (start + head)
    kind = np.where(constant, 0, np.where(plain, 1, np.where(order == 2, 0b100001, 8 + order)))
    _put(bits, body, kind << 1, 8)
    i = np.flatnonzero(constant)
    _put(bits, body[i] + 8, s[i, 0] & 255, 8)
    i = np.flatnonzero(plain)
    if len(i):
        at = (body[i] + 8)[:, None] + 8 * np.arange(BLOCK)
        ok = inside[i]
        _put(bits, at[ok], s[i][ok] & 255, 8)
    for j in range(2):
        i = np.flatnonzero(rice & (order > j))
        _put(bits, body[i] + 8 + 8 * j, s[i, j] & 255, 8)
    i = np.flatnonzero(rice & (order == 2))
    at = body[i] + 24
    _put(bits, at, np.full(len(i), PRECISION - 1), 4)
    _put(bits, at + 4, np.full(len(i), SHIFT), 5)
    for j in range(2):
        _put(bits, at + 9 + PRECISION * j, quant[j][i] & ((1 << PRECISION) - 1), PRECISION)
    i = np.flatnonzero(rice)
    _put(bits, body[i] + fixed[i] - 4, k[i], 4)
    use = coded & rice[:, None]
    first = np.cumsum(length, 1) - length + (body + fixed)[:, None]
    at, z, kk = (first + q)[use], z[use], np.broadcast_to(k[:, None], use.shape)[use]
    bits[at] = 1
    for j in range(int(k[rice].max()) if rice.any() else 0):
        more = kk > j
        bits[(at + kk - j)[more]] = (z[more] >> j) & 1
    out = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    out[np.repeat(start - (np.cumsum(head) - head), head) + np.arange(len(flat))] = flat
    end = start + frame - 2
    crc = crc16(out, start, end)
    out[end], out[end + 1] = crc >> 8, crc & 255
    return out.tobytes(), frame


def _stream(payload: bytes, frames: list[int], sizes: list[int], body: bytes = b"") -> bytes:
    """Marker, STREAMINFO and SEEKTABLE before the frames."""
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest()
    fields = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + min(frames, default=0).to_bytes(3, "big") + max(frames, default=0).to_bytes(3, "big") + fields.to_bytes(8, "big") + md5
    at = np.cumsum([0, *frames[:-1]]) if frames else np.zeros(0, np.int64)
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"], points["offset"], points["n"] = np.arange(len(frames)) * BLOCK, at, sizes
    seek = points[::SEEK_EVERY].tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + body


def _metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO, the seek points, and where the frames start."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, got = 4, False, {"seek": []}
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block, last, at = stream[at + 4 : at + 4 + n], kind >> 7, at + 4 + n
        if kind & 127 == 0:
            x = int.from_bytes(block[10:18], "big")
            got |= {"block": int.from_bytes(block[:2], "big"), "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "total": x & ((1 << 36) - 1), "md5": block[18:34]}
        elif kind & 127 == 3:
            points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            got["seek"] = [x for x in points.tolist() if x[0] != 2**64 - 1]
    if "bits" not in got:
        raise ValueError("no STREAMINFO")
    return got, at


def _read_header(s: bytes, h: int, info: dict) -> tuple[int, int, int, int, int] | None:
    """(first sample, samples, channel assignment, bits, end of the header) of a frame that starts at
    ``h``; None if none does."""
    if len(s) < h + 6 or s[h] != 0xFF or s[h + 1] & 0xFE != 0xF8:
        return None
    size, rate, channels, bits = s[h + 2] >> 4, s[h + 2] & 15, s[h + 3] >> 4, s[h + 3] >> 1 & 7
    ones = 8 - (s[h + 4] ^ 0xFF).bit_length()
    if not size or rate == 15 or channels > 10 or bits == 3 or s[h + 3] & 1 or ones in (1, 8):
        return None
    e = h + 4 + max(1, ones)
    number = s[h + 4] & (0x7F >> ones)
    for x in s[h + 5 : e]:
        number = number << 6 | x & 63
    if size in (6, 7):
        n, e = int.from_bytes(s[e : e + size - 5], "big") + 1, e + size - 5
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    e += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if e >= len(s) or crc8(s[h:e]) != s[e]:
        return None
    # Sample sizes by their code
    width = (info["bits"], 8, 12, 0, 16, 20, 24, 32)[bits]
    return (number if s[h + 1] & 1 else number * info["block"]), n, channels, width, e + 1


def _frames(stream: bytes, checked: bool = False) -> tuple[list[tuple[int, ...]], dict]:
    """(first sample, samples, channel assignment, bits, start, end of the header, end) of each frame.
    A frame ends where the header of the next one is; ``checked``: and where its CRC-16 holds."""
    info, at = _metadata(stream)
    body = np.frombuffer(stream, np.uint8, offset=at)
    places = (at + np.flatnonzero((body[:-1] == 0xFF) & (body[1:] & 0xFE == 0xF8))).tolist() if len(body) > 1 else []
    out: list[tuple[int, ...]] = []
    start, head = at, _read_header(stream, at, info)
    if head is None and at < len(stream):
        raise ValueError("no frame, or CRC-8 of its header, at sample 0")
    for h in places:
        if head is None or h < start + 8 or (got := _read_header(stream, h, info)) is None or got[0] != head[0] + head[1]:
            continue
        if checked and int(crc16(np.frombuffer(stream, np.uint8), np.array([start]), np.array([h - 2]))[0]) != int.from_bytes(stream[h - 2 : h], "big"):
            continue
        out.append((*head[:4], start, head[4], h))
        start, head = h, got
    if head is not None:
        out.append((*head[:4], start, head[4], len(stream)))
    return out, info


def _crc_fails(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (raw[end - 2].astype(np.int64) << 8 | raw[end - 1]) != crc16(raw, start, end - 2)


def decode_pcm(streams: list[bytes]) -> list[tuple[np.ndarray, dict, list[tuple[int, int]]]]:
    """Of each stream: the samples (a row for each, a column for each channel), its STREAMINFO, and its
    blocks as (first sample, byte offset)."""
    parsed = []
    for s in streams:
        frames, info = _frames(s)
        at = np.array([f[4:] for f in frames], np.int64).reshape(-1, 3)
        raw = np.frombuffer(s, np.uint8)
        if len(at) and ((at[:, 2] - at[:, 1] < 3).any() or _crc_fails(raw, at[:, 0], at[:, 2]).any()):
            frames, info = _frames(s, True)  # what looked like a header may have been data
            at = np.array([f[4:] for f in frames], np.int64).reshape(-1, 3)
            if _crc_fails(raw, at[:, 0], at[:, 2]).any():
                raise ValueError("CRC-16 of a frame, or CRC-8 of the next header")
        parsed.append((frames, info))
    owner = [(i, f) for i, (frames, _) in enumerate(parsed) for f in frames]
    pieces: list[list[np.ndarray]] = [[] for _ in streams]
    for lo in range(0, len(owner), CHUNK):
        some = owner[lo : lo + CHUNK]
        data, shift = [], []
        used = 0
        for i, f in some:
            data.append(streams[i][f[4] : f[6]])
            shift.append(used - f[4])
            used += f[6] - f[4]
        f = np.array([f for _, f in some], np.int64)
        samples = _decode_blocks(b"".join(data), f[:, 1], f[:, 2], f[:, 3], f[:, 5] + np.array(shift))
        for (i, x), own in zip(some, samples, strict=True):
            channels = x[2] + 1 if x[2] < 8 else 2
            pieces[i].append(own[: x[1], :channels])
    out = []
    for own, (frames, info) in zip(pieces, parsed, strict=True):
        pcm = np.concatenate(own) if own else np.zeros((0, info["channels"]), np.int32)
        if any(info["md5"]) and hashlib.md5(pcm_bytes(pcm, info["bits"])).digest() != info["md5"]:
            raise ValueError("MD5 of the samples")
        if info["total"] and info["total"] != len(pcm):
            raise ValueError("number of samples")
        out.append((pcm, info, [(f[0], f[4]) for f in frames]))
    return out


def pcm_bytes(pcm: np.ndarray, bits: int) -> bytes:
    """Interleaved signed samples, little end first, in whole bytes."""
    width = -(-bits // 8)
    return np.ascontiguousarray(pcm, "<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def decode_many(streams: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """The payload of each of this encoder's streams, and its blocks as (first sample, byte offset)."""
    got = decode_pcm(streams)
    return [((pcm[:, 0] + 128).astype(np.uint8)).tobytes() for pcm, _, _ in got], [where for _, _, where in got]


def samples_at(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples ``first`` to ``first + count``, reading only from the last seek point before them on, and
    decoding only the blocks that hold them."""
    info, at = _metadata(stream)
    points = [(sample, at + offset) for sample, offset, _ in info["seek"]]
    start = max((h for sample, h in points if sample <= first), default=at)
    stop = min((h for sample, h in points if sample >= first + count and h > start), default=len(stream))
    frames, _ = _frames(stream[:at] + stream[start:stop])
    need = [f for f in frames if f[0] < first + count and f[0] + f[1] > first]
    if not need:
        return np.zeros((0, info["channels"]), np.int64)
    raw = np.frombuffer(stream[:at] + stream[start:stop], np.uint8)
    f = np.array(need, np.int64)
    if _crc_fails(raw, f[:, 4], f[:, 6]).any():
        raise ValueError("CRC-16 of a frame")
    pcm = _decode_blocks(raw.tobytes(), f[:, 1], f[:, 2], f[:, 3], f[:, 5])
    pcm = np.concatenate([x[: h[1], : info["channels"]] for x, h in zip(pcm, need, strict=True)])
    skip = max(0, first - need[0][0])
    return pcm[skip : skip + count]


class _Bits:
    """Bits at any places of some bytes."""

    def __init__(self, data: bytes) -> None:
        self.raw = np.frombuffer(data + bytes(16), np.uint8)
        self.words = np.zeros(len(self.raw) - 8, np.uint64)  # the 8 bytes from each byte on
        for j in range(8):
            self.words |= self.raw[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, k) -> np.ndarray:
        """k bits (an int or array, under 50) at each place."""
        return ((self.window(pos) >> np.uint64(1)) >> (np.uint64(63) - np.asarray(k, np.uint64))).astype(np.int64)

    def signed(self, pos: np.ndarray, k) -> np.ndarray:
        x, k = self.read(pos, k), np.asarray(k)
        return np.where((k > 0) & (x >> np.maximum(k - 1, 0) & 1 == 1), x - (1 << k), x)

    def zeros(self, pos: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """How many 0 bits there are before the next 1."""
        x = self.window(pos) if x is None else x
        top = (x >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1].astype(np.int64)
        if not top.all():  # over 31: count on, a bit at a time
            for r in np.flatnonzero(top == 0).tolist():
                c = int(pos[r])
                while not self.raw[c >> 3] >> (7 - (c & 7)) & 1:
                    c += 1  # an IndexError at the end of damaged data
                q[r] = c - int(pos[r])
        return q


def _decode_blocks(data: bytes, size: np.ndarray, assigned: np.ndarray, bits: np.ndarray, body: np.ndarray) -> np.ndarray:
    """(block, sample, channel) of frames whose subframes start at byte ``body``."""
    source, pos = _Bits(data), body * 8
    channels = np.where(assigned < 8, assigned + 1, 2)
    out = np.zeros((len(size), int(size.max()), int(channels.max())), np.int64)
    for c in range(out.shape[2]):
        on = np.flatnonzero(channels > c)
        side = ((assigned[on] == 9) & (c == 0)) | ((assigned[on] == 8) & (c == 1)) | ((assigned[on] == 10) & (c == 1))
        got, pos[on] = _subframes(source, pos[on], bits[on] + side, size[on])
        out[on, : got.shape[0], c] = got.T
    for kind in np.unique(assigned[assigned >= 8]).tolist():
        on = np.flatnonzero(assigned == kind)
        a, b = out[on, :, 0], out[on, :, 1]
        if kind == 8:
            b = a - b
        elif kind == 9:
            a = a + b
        else:
            mid = a << 1 | b & 1
            a, b = mid + b >> 1, mid - b >> 1
        out[on, :, 0], out[on, :, 1] = a, b
    return out


def _subframes(source: _Bits, pos: np.ndarray, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One channel of each block, as (sample, block), and where its subframes end."""
    n, width = len(size), int(size.max())
    pos = pos.copy()
    head = source.read(pos, 8)
    kind, pos = head >> 1, pos + 8
    wasted = np.zeros(n, np.int64)
    on = np.flatnonzero(head & 1)
    if len(on):
        wasted[on] = source.zeros(pos[on]) + 1
        pos[on] += wasted[on]
    bits = bits - wasted
    constant, plain, lpc, fixed = kind == 0, kind == 1, (kind >= 32) & (kind < 64), (kind >= 8) & (kind <= 12)
    if not (constant | plain | lpc | fixed).all():
        raise ValueError("a reserved kind of subframe")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    if (order > size).any():
        raise ValueError("a predictor longer than its block")
    most = int(order.max())
    s = np.zeros((width + most, n), np.int64)  # a row for each sample; ``most`` empty rows before the first
    live = np.flatnonzero(constant)
    if len(live):
        s[most:, live] = source.signed(pos[live], bits[live])
        pos[live] += bits[live]
    live = np.flatnonzero(plain)
    for i in range(int(size[live].max()) if len(live) else 0):
        on = live[size[live] > i]
        s[most + i, on] = source.signed(pos[on], bits[on])
        pos[on] += bits[on]
    for j in range(most):
        on = np.flatnonzero(order > j)
        s[most + j, on] = source.signed(pos[on], bits[on])
        pos[on] += bits[on]
    coef, shift = np.zeros((n, most), np.int64), np.zeros(n, np.int64)
    # The fixed predictors
    for k, row in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        coef[np.flatnonzero(fixed & (order == k))[:, None], np.arange(k)[None, :]] = row
    on = np.flatnonzero(lpc)
    if len(on):
        precision = source.read(pos[on], 4) + 1
        shift[on] = source.signed(pos[on] + 4, 5)
        if (precision > 15).any() or (shift < 0).any():
            raise ValueError("a reserved form of linear predictor")
        pos[on] += 9
        for j in range(most):
            more = order[on] > j
            coef[on[more], j] = source.signed(pos[on[more]], precision[more])
            pos[on[more]] += precision[more]
    on = np.flatnonzero(~constant & ~plain)
    if len(on):
        on = on[np.argsort(-size[on], kind="stable")]  # those still running are always the first ones
        t, pos[on] = _residuals(source, pos[on], np.ascontiguousarray(s[:, on]), size[on], order[on], coef[on], shift[on])
        s[:, on] = t
    return s[most:] << wasted, pos


def _residuals(source: _Bits, p: np.ndarray, t: np.ndarray, m: np.ndarray, o: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fill ``t`` with predicted and corrected samples, one row (a sample of all blocks) at a time."""
    most, width = coef.shape[1], len(t) - coef.shape[1]
    method = source.read(p, 2)
    if (method > 1).any():
        raise ValueError("a reserved Rice method")
    param, parts = 4 + method, np.left_shift(1, source.read(p + 2, 4))
    p, per = p + 6, m // parts
    k, escaped = np.zeros(len(m), np.int64), np.zeros(len(m), bool)

    def begin(rows: np.ndarray) -> None:
        """The next partition of some blocks."""
        k[rows] = source.read(p[rows], param[rows])
        p[rows] += param[rows]
        escaped[rows] = k[rows] == (1 << param[rows]) - 1
        if (plain := rows[escaped[rows]]).size:
            k[plain] = source.read(p[plain], 5)
            p[plain] += 5

    begin(np.arange(len(m)))
    running = np.searchsorted(-m, -np.arange(width), "left")  # blocks of over i samples
    several = np.unique(per[parts > 1]).tolist()
    latest = int(o.max())
    for i in range(width):
        f = int(running[i])
        if i and any(i % u == 0 for u in several if u):
            begin(np.flatnonzero((parts[:f] > 1) & (i % np.maximum(per[:f], 1) == 0)))
        pp, kk = p[:f], k[:f]
        x = source.window(pp)
        if escaped[:f].any():
            raw = escaped[:f]
            q = np.where(raw, -1, 0)
            q[~raw] = source.zeros(pp[~raw], x[~raw])
            rest = source.read(pp + q + 1, kk)
            z = np.where(raw, 0, q) << kk | rest
            value = np.where(raw, source.signed(pp, kk), (z >> 1) ^ -(z & 1))
        else:
            q = source.zeros(pp, x)
            if len(q) and int(q.max()) + int(kk.max()) > 55:
                rest = source.read(pp + q + 1, kk)
            else:
                rest = ((x << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            z = q << kk | rest
            value = (z >> 1) ^ -(z & 1)
        if most:
            guess = coef[:f, 0] * t[i + most - 1, :f]
            for j in range(1, most):
                guess += coef[:f, j] * t[i + most - 1 - j, :f]
            value += guess >> shift[:f]
        if i < latest:  # the first samples are given as they are
            coded = o[:f] <= i
            t[i + most, :f] = np.where(coded, value, t[i + most, :f])
            p[:f] += np.where(coded, q + 1 + kk, 0)
        else:
            t[i + most, :f] = value
            p[:f] += q + 1 + kk
    return t, p


def _batches(values: list[bytes], each):
    at = np.cumsum([0, *map(len, values)])
    for i, j in C.steps(at, BATCH_BYTES):
        yield from each(values[i:j])


def encode(df: DataFrame, payload: str, *, media: str = "media") -> DataFrame:
    """``df`` with the FLAC stream of each payload (binary)."""

    def f(col: pa.Array) -> list[pa.Array]:
        return [pa.array(list(_batches([x or b"" for x in col.to_pylist()], encode_many)), pa.binary())]

    return C.with_arrow(df, payload, [T.StructField(media, T.BinaryType())], lambda: f)


SEEK = T.ArrayType(T.StructType([T.StructField("first_sample", T.LongType()), T.StructField("byte_offset", T.LongType())]))


def decode(df: DataFrame, media: str, *, payload: str = "payload") -> DataFrame:
    """``df`` with what each stream holds: the payload, ``seek`` (first sample and byte offset of its
    blocks) and ``feature``, the samples' energy, zero crossings and peak as ``energy:crossings:peak``.
    Null stays null."""

    def read(streams: list[bytes]):
        for (pcm, _, where), size in zip(decode_pcm(streams), map(len, streams), strict=True):
            v = pcm[:, 0]
            yield (v + 128).astype(np.uint8).tobytes(), [{"first_sample": x, "byte_offset": y} for x, y in where if y < size], f"{int(v @ v)}:{int(np.count_nonzero((v[1:] < 0) != (v[:-1] < 0)))}:{int(np.abs(v).max(initial=0))}"

    def f(col: pa.Array) -> list[pa.Array]:
        all_ = col.to_pylist()
        got = iter(_batches([x for x in all_ if x is not None], read))
        rows = [(None, None, None) if x is None else next(got) for x in all_]
        kinds = (pa.binary(), pa.list_(pa.struct([("first_sample", pa.int64()), ("byte_offset", pa.int64())])), pa.string())
        return [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]

    return C.with_arrow(df, media, [T.StructField(payload, T.BinaryType()), T.StructField("seek", SEEK), T.StructField("feature", T.StringType())], lambda: f)


def blocks(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each PCM block of any FLAC stream: key, block number, first sample, byte offset in the
    stream, and the samples as interleaved signed little-endian integers of whole bytes."""
    schema = T.StructType([df.schema[key], T.StructField("block", T.IntegerType()), T.StructField("first_sample", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches):
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                [(pcm, info, where)] = decode_pcm([m])
                ends = [*(x for x, _ in where[1:]), len(pcm)]
                out = [(k, n, at, byte, pcm_bytes(pcm[at:end], info["bits"])) for n, ((at, byte), end) in enumerate(zip(where, ends, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=schema.names)

    return C.map_arrow(df.select(key, media), run, schema)


def padded(text: Column) -> Column:
    """UTF-8 bytes with bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    short = F.when(F.octet_length(raw) == 0, 64).otherwise(F.pmod(-F.octet_length(raw), F.lit(64)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), short)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded(F.col("text")).alias("raw"))
    held = C.stored(encode(rows, "raw").select("doc_id", "n_bytes", "media"), "media")
    return decode(held, "media").select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("seek").cast("long").alias("n_blocks"),
        F.element_at("seek", -1)["byte_offset"].alias("last_block_at"),
    )
