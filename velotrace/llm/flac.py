"""FLAC streams of one channel, coded and decoded for many streams in step.

Frames don't depend on one another, so the decoder takes the frames of all streams of a batch side by side: at step t
it reads sample t of every frame, a Rice code each, and adds the linear prediction. The encoder writes a seek point for
every frame; streams without a full seek table are followed frame by frame, all streams in step. Every frame's header
and body checksums are verified, and the MD5 of the samples where a whole stream is read.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

from .common import offsets

BLOCK = 1024
#: Samples coded, and frames decoded, at a time; bounds of memory, without effect on streams.
AT_A_TIME, FRAMES = 1_000_000, 1500
RATE = 8000
#: Coefficients of the fixed predictors of order 0 to 4. Fixed values of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 12, 9
#: Block sizes and sample sizes by their codes in a frame header. Fixed values of the format.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 256 << (c - 8) for c in range(8, 16)}}
BITS_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class FlacError(ValueError):
    """A stream that isn't valid or isn't supported."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out & (1 << (bits - 1)), (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_all(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-16 of each slice of the buffer, all in step."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(order), np.uint32)
    if len(order):
        live = np.searchsorted(-left, -np.arange(int(left[0])) - 1, "right")  # slices longer than t
        for t, n in enumerate(live.tolist()):
            c = crc[:n]
            crc[:n] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ buffer[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *tail])


def _words(total_bits: int, pos: np.ndarray, value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Puts values of a width up to 64 bits at bit positions, which must ascend, into big-endian words."""
    words = np.zeros(total_bits // 64 + 2, np.uint64)
    if not len(pos):
        return words
    at, shift = pos >> 6, 64 - (pos & 63) - width
    fits = shift >= 0
    first = np.where(fits, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[begin]] |= np.bitwise_or.reduceat(first, begin)
    over = np.flatnonzero(~fits)  # one value a word at most runs over into the next
    words[at[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    return words


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc(x: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients of each row by its autocorrelation."""
    y = np.where(inside, x, 0).astype(np.float32 if x.shape[1] <= 1024 else np.float64)  # sums stay whole numbers either way
    auto = np.stack([np.einsum("ij,ij->i", y[:, : y.shape[1] - k], y[:, k:]) for k in range(order + 1)], axis=1).astype(np.float64)
    lag = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
    m = auto[:, lag] + np.eye(order) * (auto[:, :1, None] * 1e-4 + 1)
    c = np.linalg.solve(m, auto[:, 1:, None])[:, :, 0]
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(c * (1 << LPC_SHIFT)), -top - 1, top).astype(np.int32)


def _coded(payload: np.ndarray, sizes: np.ndarray, first: np.ndarray, block: int, lpc_order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of runs of samples, numbered from first on: their bytes, where each begins, and the samples of each."""
    at = offsets(sizes)
    n_frames = -(-sizes // block)
    stream = np.repeat(np.arange(len(sizes)), n_frames)
    place = np.arange(len(stream)) - np.repeat(offsets(n_frames)[:-1], n_frames)
    number = place + first[stream]
    n = np.minimum(block, sizes[stream] - place * block)
    begin = at[stream] + place * block
    f = len(stream)
    cell = np.arange(block)[None, :]
    inside = cell < n[:, None]
    x = payload[np.minimum(begin[:, None] + cell, max(len(payload) - 1, 0))].astype(np.int32) - 128
    x[~inside] = 0

    # the predictor with the least sum of folded residuals
    best, kind, folded = np.full(f, np.iinfo(np.int64).max), np.zeros(f, np.int64), np.zeros_like(x)
    r = x
    for order in range(5):
        if order:
            r = r[:, 1:] - r[:, :-1]
        u = _zigzag(r)
        u[~inside[:, order:]] = 0
        cost = u.sum(axis=1, dtype=np.int64) + 12 * order
        win = np.flatnonzero((cost < best) & (n > order))
        best[win], kind[win] = cost[win], order
        folded[win, :order], folded[win, order:] = 0, u[win]
    coef = np.zeros((f, max(lpc_order, 1)), np.int32)
    if lpc_order:
        coef = _lpc(x, inside, lpc_order)
        guess = sum(coef[:, j : j + 1] * x[:, lpc_order - 1 - j : block - 1 - j] for j in range(lpc_order)) >> LPC_SHIFT
        u = _zigzag(x[:, lpc_order:] - guess)
        u[~inside[:, lpc_order:]] = 0
        cost = u.sum(axis=1, dtype=np.int64) + 12 * lpc_order + LPC_BITS * lpc_order * 2
        win = np.flatnonzero((cost < best) & (n > lpc_order))
        best[win], kind[win] = cost[win], 8 + lpc_order
        folded[win, :lpc_order], folded[win, lpc_order:] = 0, u[win]
    order = np.where(kind >= 8, kind - 8, kind)
    coded = n - order
    mean = folded.sum(axis=1, dtype=np.int64) / np.maximum(coded, 1)
    guess_k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64), 0, 13)
    bits, k = np.full(f, np.iinfo(np.int64).max), np.zeros(f, np.int64)
    for step in (0, 1):
        some = guess_k + step
        b = (folded >> some[:, None]).sum(axis=1, dtype=np.int64) + coded * (1 + some)
        k, bits = np.where(b < bits, some, k), np.minimum(bits, b)
    lpc_head = np.where(kind >= 8, 4 + 5 + order * LPC_BITS, 0)
    body = 8 + order * 8 + lpc_head + 6 + 4 + bits
    verbatim = body >= 8 + 8 * n
    constant = ((x == x[:, :1]) | ~inside).all(axis=1)
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    kind = np.where(constant, -2, np.where(verbatim, -1, kind))

    heads = []
    for i, m in zip(number.tolist(), n.tolist()):
        power = m.bit_length() - 1
        code = power if m == 1 << power and 8 <= power <= 15 else 7
        h = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _number(i) + (b"" if code != 7 else (m - 1).to_bytes(2, "big"))
        heads.append(h + bytes([crc8(h)]))
    head_size = np.fromiter(map(len, heads), np.int64, f)
    body_bytes = (body + 7) // 8
    frame_bytes = head_size + body_bytes + 2
    frame_at = offsets(frame_bytes)
    body_at = (frame_at[:-1] + head_size) * 8

    # all bit fields, in ascending order of position within each frame and between frames
    pos, val, wid = [], [], []

    def put(rows: np.ndarray, where, value, width) -> None:
        pos.append(np.broadcast_to(where, rows.shape).astype(np.int64))
        val.append(np.broadcast_to(value, rows.shape).astype(np.int64))
        wid.append(np.broadcast_to(width, rows.shape).astype(np.int64))

    every = np.arange(f)
    type_ = np.select([kind == -2, kind == -1, kind >= 8], [0, 1, 32 + order - 1], 8 + order)
    put(every, body_at, type_ << 1, 8)
    plain = np.flatnonzero(kind == -2)
    put(plain, body_at[plain] + 8, x[plain, 0] & 255, 8)
    raw_row, raw_cell = np.nonzero(inside & (kind == -1)[:, None])
    put(raw_row, body_at[raw_row] + 8 + 8 * raw_cell, x[raw_row, raw_cell] & 255, 8)
    predicted = np.flatnonzero(kind >= 0)
    for j in range(max(4, lpc_order)):
        rows = predicted[order[predicted] > j]
        put(rows, body_at[rows] + 8 + 8 * j, x[rows, j] & 255, 8)
    after = body_at + 8 + 8 * order
    rows = np.flatnonzero(kind >= 8)
    put(rows, after[rows], (LPC_BITS - 1) << 5 | LPC_SHIFT, 9)
    for j in range(lpc_order):
        put(rows, after[rows] + 9 + LPC_BITS * j, coef[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    after = after + lpc_head
    put(predicted, after[predicted], k[predicted], 10)  # method 0, one partition, its parameter
    row, c = np.nonzero(inside & (kind >= 0)[:, None] & (cell >= order[:, None]))
    u, kk = folded[row, c].astype(np.int64), k[row]
    length = (u >> kk) + 1 + kk
    run = offsets(length)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    inner = run[:-1] - np.repeat(run[first], np.diff(np.append(first, len(row))))
    ends = after[row] + 10 + inner + length
    put(row, ends - kk - 1, (1 << kk) | (u & ((1 << kk) - 1)), kk + 1)

    total = int(frame_at[-1]) * 8
    out = np.zeros(int(frame_at[-1]) + 16, np.uint8)
    for p, v, w in ((np.concatenate(pos[:-1]), np.concatenate(val[:-1]), np.concatenate(wid[:-1])), (pos[-1], val[-1], wid[-1])):
        o = np.argsort(p, kind="stable") if p is not pos[-1] else slice(None)
        words = _words(total, p[o], v[o].astype(np.uint64), w[o])
        out |= words.astype(">u8").view(np.uint8)[: len(out)] if 8 * len(words) >= len(out) else np.pad(words.astype(">u8").view(np.uint8), (0, len(out) - 8 * len(words)))
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    out[np.arange(len(flat_heads)) + np.repeat(frame_at[:-1] - offsets(head_size)[:-1], head_size)] = flat_heads
    crc = crc16_all(out, frame_at[:-1], frame_bytes - 2)
    out[frame_at[1:] - 2], out[frame_at[1:] - 1] = crc >> 8, crc & 255

    return out, frame_at, n


def encode(payload: np.ndarray, sizes: np.ndarray, block: int = BLOCK, lpc_order: int = LPC_ORDER) -> list[bytes]:
    """Streams of unsigned 8-bit samples, given one after another with the number of samples of each (at least 1)."""
    at = offsets(sizes)
    long = AT_A_TIME // block * block
    runs = [(i, s, min(s + long, n)) for i, n in enumerate(sizes.tolist()) for s in range(0, n, long)]
    parts: list[list[bytes]] = [[] for _ in sizes]
    frames: list[list[tuple[int, int]]] = [[] for _ in sizes]  # bytes and samples of each
    begin = 0
    while begin < len(runs):
        end, total = begin, 0
        while end < len(runs) and (end == begin or total + runs[end][2] - runs[end][1] <= AT_A_TIME):
            total += runs[end][2] - runs[end][1]
            end += 1
        group = runs[begin:end]
        low, high = int(at[group[0][0]]) + group[0][1], int(at[group[-1][0]]) + group[-1][2]
        out, frame_at, n = _coded(payload[low:high], np.array([b - a for _, a, b in group], np.int64), np.array([a // block for _, a, _ in group], np.int64), block, lpc_order)
        edge = offsets(np.array([-(-(b - a) // block) for _, a, b in group], np.int64)).tolist()
        bounds, counts, raw = frame_at.tolist(), n.tolist(), memoryview(out)
        for (i, _, _), a, b in zip(group, edge, edge[1:]):
            parts[i].append(raw[bounds[a] : bounds[b]].tobytes())
            frames[i] += [(y - x, m) for x, y, m in zip(bounds[a:b], bounds[a + 1 : b + 1], counts[a:b])]
        begin = end
    signed = memoryview((payload ^ np.uint8(128)).tobytes())
    streams = []
    for i, size in enumerate(sizes.tolist()):
        length = np.array([x for x, _ in frames[i]], np.int64)
        points = np.zeros(len(length), np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]))
        points["sample"], points["at"], points["n"] = np.arange(len(length)) * block, offsets(length)[:-1], [m for _, m in frames[i]]
        head = struct.pack(">HH", max(block, 16), max(block, 16)) + int(length.min()).to_bytes(3, "big") + int(length.max()).to_bytes(3, "big")
        head += (RATE << 44 | 0 << 41 | 7 << 36 | size).to_bytes(8, "big") + hashlib.md5(signed[at[i] : at[i + 1]]).digest()
        table = points.tobytes()
        if len(table) >= 1 << 24:
            table = b""  # beyond what a metadata block can hold
        seek = bytes([0x83]) + len(table).to_bytes(3, "big") + table
        streams.append(b"".join([b"fLaC", bytes([0]), len(head).to_bytes(3, "big"), head, seek, *parts[i]]))
    return streams


@dataclass
class Info:
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    frames_at: int
    points: np.ndarray


def info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, found, points = 4, False, None, np.zeros((0, 3), np.int64)
    while not last:
        if at + 4 > len(data):
            raise FlacError("the metadata is cut off")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        part = data[at + 4 : at + 4 + size]
        if len(part) < size:
            raise FlacError("the metadata is cut off")
        if kind == 0 and size >= 34:
            packed = int.from_bytes(part[10:18], "big")
            found = (int.from_bytes(part[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, part[18:34])
        elif kind == 3:
            p = np.frombuffer(part, np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]), size // 18)
            p = p[p["sample"] != np.uint64(0xFFFFFFFFFFFFFFFF)]
            points = np.stack([p["sample"].astype(np.int64), p["at"].astype(np.int64), p["n"].astype(np.int64)], axis=1)
        at += 4 + size
    if not found:
        raise FlacError("no stream information")
    if found[2] != 1:
        raise FlacError(f"{found[2]} channels; one is supported")
    return Info(*found, at, points)


class _Frames:
    """Frames at byte positions of a buffer, decoded in step."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, bits: np.ndarray, limit: np.ndarray):
        self.raw = buffer
        self.view = np.ndarray((max(len(buffer) - 7, 0),), ">u8", buffer, strides=(1,))
        f = len(starts)
        self.n, self.end, self.error = np.zeros(f, np.int64), starts.copy(), np.zeros(f, bool)
        self.bits = bits.copy()
        self.at = np.zeros(f, np.int64)
        data = buffer.tobytes() if f else b""
        for i, s in enumerate(starts.tolist()):
            try:
                self.at[i] = self._head(data, i, s, int(limit[i])) * 8
            except (IndexError, FlacError):
                self.error[i] = True
        top = int(self.n.max(initial=0))
        self.x = np.zeros((top, f), np.int64)
        self.start, self.limit = starts, limit * 8

    def _head(self, data: bytes, i: int, s: int, limit: int) -> int:
        if data[s] != 0xFF or data[s + 1] & 0xFE != 0xF8 or data[s + 3] & 0xF1:
            raise FlacError("no frame of one channel here")
        p, first = s + 4, data[s + 4]
        p += 1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
        code, rate = data[s + 2] >> 4, data[s + 2] & 15
        if code in (6, 7):
            n = int.from_bytes(data[p : p + code - 5], "big") + 1
            p += code - 5
        else:
            n = BLOCK_CODES.get(code, 0)
        p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if not n or p >= limit or crc8(data[s:p]) != data[p]:
            raise FlacError("a frame header is damaged")
        size = data[s + 3] >> 1 & 7
        if size:
            self.bits[i] = BITS_CODES[size]
        self.n[i] = n
        return p + 1

    def take(self, rows: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of up to 32 bits at the rows' positions, which move on."""
        at = self.at[rows]
        w = self.view[np.minimum(at >> 3, len(self.view) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)
        width = np.broadcast_to(np.asarray(width, np.int64), rows.shape)
        self.at[rows] = at + width
        return ((w >> np.uint64(1)) >> (63 - width).astype(np.uint64)).astype(np.int64)

    def signed(self, rows: np.ndarray, width) -> np.ndarray:
        v = self.take(rows, width)
        half = np.int64(1) << (np.broadcast_to(np.asarray(width, np.int64), rows.shape) - 1)
        return (v ^ half) - half

    def run(self) -> None:
        rows = np.flatnonzero(~self.error)
        head = self.take(rows, 8)
        kind = head >> 1
        self.error[rows[(head & 0x81) != 0]] = True  # wasted bits aren't supported
        c = rows[kind == 0]
        if len(c):
            v = self.signed(c, self.bits[c])
            self.x[:, c] = v[None, :]
        raw = rows[kind == 1]
        for t in range(int(self.n[raw].max(initial=0))):
            r = raw[self.n[raw] > t]
            self.x[t, r] = self.signed(r, self.bits[r])
        fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
        self.error[rows[~(fixed | lpc | (kind < 2))]] = True
        self._predicted(rows[fixed | lpc], np.where(lpc, kind - 31, kind - 8)[fixed | lpc], lpc[fixed | lpc])
        body = (self.at + 7) >> 3
        good = np.flatnonzero(~self.error & (self.at <= self.limit - 16))
        self.error[(self.at > self.limit - 16)] = True
        if len(good):
            crc = crc16_all(self.raw, self.start[good], body[good] - self.start[good])
            stored = self.raw[body[good]].astype(np.uint32) << 8 | self.raw[body[good] + 1]
            self.error[good[crc != stored]] = True
        self.end = body + 2

    def _predicted(self, rows: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> None:
        keep = order <= self.n[rows]
        self.error[rows[~keep]] = True
        by = np.argsort(-self.n[rows[keep]], kind="stable")
        rows, order, lpc = rows[keep][by], order[keep][by], lpc[keep][by]
        if not len(rows):
            return
        top = int(order.max())
        n, bits = self.n[rows], self.bits[rows]
        x = np.zeros((int(n[0]), len(rows)), np.int64)
        for t in range(top):
            r = np.flatnonzero(order > t)
            x[t, r] = self.signed(rows[r], bits[r])
        coef, shift = np.zeros((top, len(rows)), np.int64), np.zeros(len(rows), np.int64)
        for o in range(1, 5):
            r = np.flatnonzero(~lpc & (order == o))
            for j, c in enumerate(FIXED[o] if len(r) else ()):
                coef[j, r] = c
        r = np.flatnonzero(lpc)
        if len(r):
            width = self.take(rows[r], 4) + 1
            shift[r] = self.signed(rows[r], 5)
            self.error[rows[r[(shift[r] < 0) | (width == 16)]]] = True
            shift = np.maximum(shift, 0)
            for j in range(top):
                some = order[r] > j
                coef[j, r[some]] = self.signed(rows[r[some]], width[some])
        method = self.take(rows, 2)
        self.error[rows[method > 1]] = True
        part = n >> self.take(rows, 4)
        self.error[rows[(part < order) | (part == 0)]] = True
        part = np.maximum(part, 1)
        k, escaped = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.searchsorted(-n, -np.arange(int(n[0])) - 1, "right").tolist()
        step = int(np.gcd.reduce(part))
        any_escape = False
        at, view, last = self.at[rows], self.view, len(self.view) - 1
        one, low = np.uint64(1), int(order.min())
        for t in range(low, int(n[0])):
            m = live[t]
            if t == low or t % step == 0 or t <= top:
                here = np.flatnonzero(((t % part[:m] == 0) & (t > order[:m])) | (t == order[:m]))
                if len(here):
                    self.at[rows[here]] = at[here]
                    width = 4 + method[here]
                    p = self.take(rows[here], width)
                    raw = p == (1 << width) - 1
                    k[here], escaped[here] = np.where(raw, 0, p), 0
                    if raw.any():
                        any_escape = True
                        escaped[here[raw]] = self.take(rows[here[raw]], 5) + 1
                    at[here] = self.at[rows[here]]
            a, kk = at[:m], k[:m]
            w = view[np.minimum(a >> 3, last)].astype(np.uint64) << (a & 7).astype(np.uint64)
            high = (w >> np.uint64(32)).astype(np.float64).view(np.int64) >> 52
            q = np.where(high > 0, 1054 - high, 64)
            far = q > 31
            if far.any():
                self._long(w, a, q, np.flatnonzero(far))
                a = a + np.where(far, q, 0)
                w = np.where(far, view[np.minimum(a >> 3, last)].astype(np.uint64) << (a & 7).astype(np.uint64), w)
                skip = np.where(far, 0, q)
            else:
                skip = q
            u = q << kk | (((w << (skip + 1).astype(np.uint64)) >> one) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            r = (u >> 1) ^ -(u & 1)
            a = a + (skip + 1 + kk)
            if t < top:
                early = order[:m] > t
                a, r = np.where(early, at[:m], a), np.where(early, 0, r)
            if any_escape:
                out = np.flatnonzero((escaped[:m] > 0) & (order[:m] <= t))
                if len(out):
                    self.at[rows[out]] = at[out]
                    r[out] = np.where(escaped[out] > 1, self.signed(rows[out], np.maximum(escaped[out] - 1, 1)), 0)
                    a[out] = at[out] + escaped[out] - 1
            at[:m] = a
            if top:
                guess = coef[0, :m] * x[t - 1, :m] if t else 0
                for j in range(1, min(top, t)):
                    guess = guess + coef[j, :m] * x[t - 1 - j, :m]
                guess = guess >> shift[:m] if t else 0
                r = np.where(order[:m] > t, x[t, :m], r + guess) if t < top else r + guess
            x[t, :m] = r
        self.at[rows] = at
        self.x[: len(x), rows] = x

    def _long(self, w: np.ndarray, at: np.ndarray, q: np.ndarray, rows: np.ndarray) -> None:
        """Runs of zeros that are longer than a word's half."""
        for i in rows.tolist():
            p, end = int(at[i]), 8 * len(self.raw)
            s = p
            while p < end and not self.raw[p >> 3] >> (7 - (p & 7)) & 1:
                p += 1 if p & 7 or self.raw[p >> 3] else 8
            q[i] = min(p, end) - s


def decode(streams: list[bytes]) -> list[np.ndarray | None]:
    """Samples of each stream as signed integers; None for a stream that is damaged or not supported."""
    infos: list[Info | None] = []
    for s in streams:
        try:
            infos.append(info(s))
        except FlacError:
            infos.append(None)
    buffer = np.frombuffer(b"".join([*streams, bytes(16)]), np.uint8)
    at = offsets(np.fromiter(map(len, streams), np.int64, len(streams)))
    out: list[np.ndarray | None] = [None] * len(streams)

    def full(i: Info) -> bool:
        p = i.points
        return len(p) > 0 and i.samples > 0 and p[0, 0] == 0 and p[0, 1] == 0 and p[:, 2].sum() == i.samples and bool((p[1:, 0] == p[:-1, 0] + p[:-1, 2]).all())

    direct = [i for i, x in enumerate(infos) if x and full(x)]
    if direct:
        counts = np.array([len(infos[i].points) for i in direct], np.int64)
        owner = np.repeat(np.array(direct), counts)
        starts = np.concatenate([infos[i].points[:, 1] + at[i] + infos[i].frames_at for i in direct])
        ends = np.where(np.diff(owner, append=-1) == 0, np.append(starts[1:], 0), at[owner + 1])
        n, bits = np.concatenate([infos[i].points[:, 2] for i in direct]), np.array([infos[i].bits for i in owner])
        good, flat = np.zeros(len(starts), bool), []
        for g in range(0, len(starts), FRAMES):
            part = slice(g, g + FRAMES)
            low, high = starts[part].min(), ends[part].max()
            frames = _Frames(np.append(buffer[low:high], np.zeros(16, np.uint8)), starts[part] - low, bits[part], ends[part] - low)
            frames.run()
            good[part] = ~frames.error & (frames.end + low == ends[part]) & (frames.n == n[part])
            x = np.where(good[part], frames.x, 0) if len(frames.x) >= n[part].max() else np.zeros((int(n[part].max()), len(n[part])), np.int64)
            flat.append(x.T[np.arange(len(x))[None, :] < n[part][:, None]])
        flat, edge, sample = np.concatenate(flat), offsets(counts).tolist(), offsets(n)
        for i, a, b in zip(direct, edge, edge[1:]):
            if good[a:b].all():
                out[i] = flat[sample[a] : sample[b]]
    chained = {i: [at[i] + x.frames_at, []] for i, x in enumerate(infos) if x and i not in set(direct)}
    while live := [i for i, (p, _) in chained.items() if p < at[i + 1]]:
        frames = _Frames(buffer, np.array([chained[i][0] for i in live]), np.array([infos[i].bits for i in live]), at[np.array(live) + 1])
        frames.run()
        for j, i in enumerate(live):
            if frames.error[j]:
                chained.pop(i)
            else:
                chained[i][0] = frames.end[j]
                chained[i][1].append(frames.x[: frames.n[j], j].copy())
    for i, (_, parts) in chained.items():
        out[i] = np.concatenate([np.zeros(0, np.int64), *parts])
    for i, x in enumerate(out):
        if x is not None:
            width = (infos[i].bits + 7) // 8
            md5 = infos[i].md5
            if infos[i].samples and len(x) != infos[i].samples or any(md5) and hashlib.md5(pcm(x, width)).digest() != md5:
                out[i] = None
    return out


def pcm(samples: np.ndarray, width: int) -> bytes:
    """Little-endian signed samples of a width in bytes."""
    if width == 3:
        return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return samples.astype(f"<i{width}").tobytes()


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """Some samples of a stream with a seek table: only the frames that hold them are decoded."""
    i = info(stream)
    p = i.points
    begin, end = max(0, start), min(i.samples, start + count)
    if end <= begin:
        return np.zeros(0, np.int64)
    if not len(p):
        raise FlacError("the stream has no seek table")
    first = int(np.searchsorted(p[:, 0], begin, "right")) - 1
    last = int(np.searchsorted(p[:, 0], end, "left"))
    buffer = np.frombuffer(stream + bytes(16), np.uint8)
    frames = _Frames(buffer, p[first:last, 1] + i.frames_at, np.full(last - first, i.bits), np.full(last - first, len(stream)))
    frames.run()
    if frames.error.any():
        raise FlacError("a frame is damaged")
    flat = frames.x.T[np.arange(frames.x.shape[0])[None, :] < frames.n[:, None]]
    return flat[begin - p[first, 0] : end - p[first, 0]]
