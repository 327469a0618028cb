"""A FLAC codec for batches of mono 8-bit streams, in numpy.

All frames of a batch are worked on at once: each numpy call handles one sample (or bit run, or byte) of every frame.
The encoder writes constant, verbatim, fixed-predictor and linear-predictor subframes with partitioned Rice residuals;
the decoder reads those of any order and partitioning (one channel, up to 16 bits a sample) and checks every checksum.
"""

from __future__ import annotations

import hashlib
import numpy as np

BLOCK = 2048
#: Bytes or samples worked on at once.
WINDOW = 1 << 20
#: Fixed predictors that the encoder tries, and its linear predictor: order, bits of a coefficient, shift.
TRIED = 3
ORDER, PRECISION, SHIFT = 4, 8, 5
PARTITIONS = 2  # as a power of two
RATE = 44100

#: Fixed values of the format: coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, width: int) -> np.ndarray:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8).tolist(), crc_table(0x8005, 16).astype(np.uint16)
_two = np.arange(1 << 16, dtype=np.uint16)
_one = CRC16[_two >> 8]
CRC16_2 = (_one << 8) ^ CRC16[(_one >> 8) ^ (_two & 0xFF)]


def crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, two bytes of each at a time, longest first so that the ranges still open are a prefix."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    pairs = np.concatenate((buf, [0])).astype(np.uint16)
    pairs = pairs[:-1] << 8 | pairs[1:]
    c = np.zeros(len(at), np.uint16)
    steps = left // 2
    open_ = len(at) - np.searchsorted(steps[::-1], np.arange(1, (steps[0] if len(steps) else 0) + 1), "left")
    for k in open_.tolist():
        c[:k] = CRC16_2[c[:k] ^ pairs[at[:k]]]
        at[:k] += 2
    odd = np.flatnonzero(left & 1)
    c[odd] = (c[odd] << 8) ^ CRC16[(c[odd] >> 8) ^ buf[at[odd]]]
    out = np.empty(len(c), np.int64)
    out[order] = c
    return out


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def read_number(buf: bytes, at: int) -> tuple[int, int]:
    b = buf[at]
    if b < 0x80:
        return b, at + 1
    more = 8 - (b ^ 0xFF).bit_length() - 1
    n = b & (0x3F >> more)
    for c in buf[at + 1 : at + 1 + more]:
        n = n << 6 | c & 0x3F
    return n, at + 1 + more


def headers(sizes: list[int], first: int = 0) -> list[bytes]:
    """Headers of frames ``first`` and on of one stream, from its blocks' sizes."""
    out = []
    for k, size in enumerate(sizes, first):
        h = bytes([0xFF, 0xF8, 0x79, 0x02]) + number(k) + (size - 1).to_bytes(2, "big")  # 16-bit size, 44.1 kHz, mono, 8 bits
        out.append(h + bytes([crc8(h)]))
    return out


def residuals(x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Residuals of the fixed predictors of order 0 to TRIED - 1 over all frames; ``first`` is each sample's distance from its frame's start. The warm-up samples come out as 0."""
    out, r = [x], x
    for order in range(1, TRIED):
        r = np.concatenate(([0], r[1:] - r[:-1]))
        r[first < order] = 0
        out.append(r)
    return out


def predictor(x: np.ndarray, frame: np.ndarray, first: np.ndarray, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear-predictor coefficients of each frame by Levinson-Durbin on autocorrelations, and their residuals."""
    auto = np.empty((frames, ORDER + 1))
    start = np.flatnonzero(first == 0)
    for lag in range(ORDER + 1):
        product = np.zeros(len(x), np.int32)
        np.multiply(x[lag:], x[: len(x) - lag], out=product[lag:])
        product[first < lag] = 0
        auto[:, lag] = np.add.reduceat(product, start, dtype=np.int64)
    err, a = auto[:, 0] + 1e-9, np.zeros((frames, ORDER))
    for i in range(ORDER):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    q = np.clip(np.rint(a * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    guess = np.zeros(len(x), np.int32)
    for j in range(ORDER):
        guess[j + 1 :] += q[:, j][frame[j + 1 :]] * x[: len(x) - j - 1]
    r = x - (guess >> SHIFT)
    r[first < ORDER] = 0
    return q, r


def encode(payloads: list[bytes], block: int = BLOCK, window: int = WINDOW) -> list[bytes]:
    """Unsigned 8-bit payloads (stored as samples less 128), each of a positive multiple of 64 bytes, to whole FLAC streams whose seek table has every frame.

    Frames are made for about ``window`` bytes at a time, of however many payloads, so that memory does not grow with the longest.
    """
    step = max(1, window // block) * block
    bodies: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    held: list[tuple[int, int]] = []  # payload, first byte
    size = 0

    def work() -> None:
        for (i, _), (data, n) in zip(held, coded_frames([payloads[i][at : at + step] for i, at in held], [at // block for _, at in held], block)):
            bodies[i].append(data)
            sizes[i].append(n)
        held.clear()

    for i, p in enumerate(payloads):
        for at in range(0, len(p), step):
            held.append((i, at))
            size += min(step, len(p) - at)
            if size >= window:
                work()
                size = 0
    if held:
        work()
    result = []
    for payload, parts, own in zip(payloads, bodies, sizes):
        n = np.concatenate(own)
        offsets, length = np.cumsum(n) - n, np.minimum(block, len(payload) - np.arange(len(n)) * block)
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = block.to_bytes(2, "big") * 2 + int(n.min()).to_bytes(3, "big") + int(n.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        most = ((1 << 24) - 1) // 18  # seek points that a table can hold: in a longer stream, every so many frames
        kept = range(0, len(n), -(-len(n) // most))
        points = b"".join((i * block).to_bytes(8, "big") + int(offsets[i]).to_bytes(8, "big") + int(length[i]).to_bytes(2, "big") for i in kept)
        meta = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points
        result.append(b"".join([meta, *parts]))
    return result


def coded_frames(payloads: list[bytes], numbers: list[int], block: int) -> list[tuple[bytes, np.ndarray]]:
    """The frames of parts of streams, from the numbers of their first frames: their bytes and the size of each."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    per = -(-sizes // block)
    stream = np.repeat(np.arange(len(payloads)), per)
    k = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(block, sizes[stream] - k * block)
    frames = len(length)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    start = np.cumsum(length) - length
    spread = lambda per_frame: np.repeat(per_frame, length)
    frame = spread(np.arange(frames, dtype=np.int32))
    first = np.arange(len(x), dtype=np.int32) - spread(start.astype(np.int32))

    tried = residuals(x, first)
    q, lpc = predictor(x, frame, first, frames)
    tried.append(lpc)
    cost = np.stack([np.add.reduceat(np.abs(r), start, dtype=np.int64) for r in tried])
    best = cost.argmin(axis=0)  # the last is the linear predictor
    flat = np.add.reduceat(x != spread(x[start]), start, dtype=np.int64) == 0
    order = np.where(best == TRIED, ORDER, best)
    r = np.choose(spread(best), tried)
    fold = r << 1 ^ r >> 31

    slots = length >> PARTITIONS
    slot = first // spread(slots.astype(np.int32))
    coded = first >= spread(order)
    fold[~coded] = 0
    begin = (start[:, None] + slots[:, None] * np.arange(1 << PARTITIONS)).ravel()
    mean = np.add.reduceat(fold, begin, dtype=np.int64) / np.maximum(np.add.reduceat(coded, begin, dtype=np.int64), 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 0.5))) + 1, 0, 14).astype(np.int32)
    kk = np.repeat(rice, np.repeat(slots, 1 << PARTITIONS))
    high = fold >> kk
    bits = np.where(coded, high + 1 + kk, 8)  # warm-up samples as they are
    # a predicted subframe: 8 bits of type, warm-up, [coefficients], 6 bits, then partitions of 4 bits + codes
    extra = np.where(best == TRIED, 9 + ORDER * PRECISION, 0)
    sums = np.cumsum(bits, dtype=np.int64)
    ahead = sums - bits
    ahead -= spread(ahead[start])
    body = np.add.reduceat(bits, start, dtype=np.int64)
    rice_bits = 8 + extra + 6 + (4 << PARTITIONS) + body
    kind = np.where(flat, 0, np.where(rice_bits >= 8 + 8 * length, 1, 2))  # constant, verbatim, predicted
    sub = np.where(kind == 0, 16, np.where(kind == 1, 8 + 8 * length, rice_bits))

    heads = [h for n, k0 in zip(np.split(length, np.cumsum(per)[:-1]), numbers) for h in headers(n.tolist(), k0)]
    head_n = np.array([len(h) for h in heads], np.int64)
    frame_n = head_n + -(-sub // 8) + 2
    at = np.cumsum(frame_n) - frame_n
    words = np.zeros(int(frame_n.sum()) // 4 + 3)

    def put(where: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        """Numbers of at most 32 bits at bit positions; no two overlap, so sums of their parts in 32-bit words are exact."""
        word = where >> 5
        v = value.astype(np.uint64) << (64 - (where & 31) - width).astype(np.uint64)
        np.add(words, np.bincount(word, weights=v >> np.uint64(32), minlength=len(words)), out=words)
        np.add(words, np.bincount(word + 1, weights=v & np.uint64(0xFFFFFFFF), minlength=len(words)), out=words)

    sub_at = (at + head_n) * 8
    put(sub_at, np.where(kind == 0, 0, np.where(kind == 1, 2, np.where(best == TRIED, 64 + (ORDER - 1 << 1), 16 + (order << 1)))), 8)
    put((sub_at + 8)[kind == 0], x[start][kind == 0] & 0xFF, 8)
    raw = spread(kind == 1)
    put((spread(sub_at) + 8 + 8 * first)[raw], x[raw] & 0xFF, 8)

    pred = kind == 2
    lin = np.flatnonzero(pred & (best == TRIED))
    where = sub_at[lin] + 8 + 8 * ORDER
    put(where, np.full(len(lin), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(ORDER):
        put(where + 9 + PRECISION * j, q[lin, j] & (1 << PRECISION) - 1, PRECISION)
    put((sub_at + 8 + 8 * order + extra)[pred], np.full(int(pred.sum()), PARTITIONS), 6)
    # a sample's place: bits of the samples before it, and 6 + 4 bits before the first code, 4 before each later partition
    code_at = spread(sub_at + 8) + ahead + np.where(coded, spread(extra + 10) + 4 * slot, 0)
    p = spread(pred)
    warm, live = p & ~coded, p & coded
    put(code_at[warm], x[warm] & 0xFF, 8)
    opens = (begin + np.where(np.arange(len(begin)) % (1 << PARTITIONS) == 0, np.repeat(order, 1 << PARTITIONS), 0))[np.repeat(pred, 1 << PARTITIONS)]
    put(code_at[opens] - 4, kk[opens], 4)
    k = kk[live]
    put((code_at + high)[live], (1 << k) | (fold[live] & ((1 << k) - 1)), k + 1)
    data = words.astype(">u4").view(np.uint8)[: int(frame_n.sum())].copy()
    for f, h in enumerate(heads):
        data[at[f] : at[f] + len(h)] = np.frombuffer(h, np.uint8)
    c = crc16(data, at, frame_n - 2)
    data[at + frame_n - 2], data[at + frame_n - 1] = c >> 8, c & 0xFF

    ends = np.cumsum(per)
    return [(data[at[e - n] : at[e - n] + int(frame_n[e - n : e].sum())].tobytes(), frame_n[e - n : e]) for e, n in zip(ends.tolist(), per.tolist())]


class Corrupt(ValueError):
    """A stream that breaks the format or fails a checksum."""


RATES = {6: 1, 7: 2}
SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO, the seek points, and where frames begin."""
    if stream[:4] != b"fLaC":
        raise Corrupt("no FLAC marker")
    at, out = 4, {"seek": []}
    while True:
        kind, n = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, last = stream[at + 4 : at + 4 + n], stream[at] & 0x80
        if len(body) < n:
            raise Corrupt("metadata is cut short")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n, 18)]
        at += 4 + n
        if last:
            return out, at


def frame_header(stream: bytes, at: int, block: int) -> tuple[int, int, int]:
    """Number of the frame's first sample, samples, and where its subframe begins."""
    if at + 6 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
        raise Corrupt("frame sync lost")
    fixed, code = not stream[at + 1] & 1, stream[at + 2] >> 4
    if stream[at + 3] >> 4:
        raise Corrupt("more than one channel")
    n, p = read_number(stream, at + 4)
    size = SIZES.get(code) or int.from_bytes(stream[p : p + RATES.get(code, 1)], "big") + 1
    p += RATES.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(stream[at + 2] & 15, 0)
    if crc8(stream[at:p]) != stream[p]:
        raise Corrupt("frame header checksum")
    return n * block if fixed else n, size, p + 1


def subframes(bits: np.ndarray, next_one: np.ndarray, words: np.ndarray, where: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Decode one subframe of each stream at bit positions ``where``: samples (a row a frame, zero-padded) and the bit after each."""
    lanes = np.arange(len(where))
    out = np.zeros((len(where), int(length.max()) if len(length) else 0), np.int64)

    def get(at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Numbers of at most 25 bits."""
        return (words[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n)

    def signed(v: np.ndarray, n: int) -> np.ndarray:
        return v - ((v >> (n - 1)) << n)

    kind = get(where + 1, 6)
    if get(where, 1).any() or get(where + 7, 1).any():
        raise Corrupt("wasted bits are not supported")
    at = where + 8
    flat, raw, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (flat | raw | fixed | linear).all():
        raise Corrupt("reserved subframe type")
    out[flat] = np.where(np.arange(out.shape[1]) < length[flat, None], signed(get(at[flat], width), width)[:, None], 0)
    at[flat] += width
    for i in np.flatnonzero(raw):
        n = int(length[i])
        v = bits[at[i] : at[i] + n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1))
        out[i, :n] = signed(v, width)
        at[i] += n * width

    live = np.flatnonzero(fixed | linear)
    if not len(live):
        return out, at
    order = np.where(fixed, kind & 7, (kind & 31) + 1)[live]
    a, n = at[live], length[live]
    x = np.zeros((len(live), out.shape[1]), np.int64)
    for j in range(int(order.max())):
        some = order > j
        x[some, j] = signed(get(a[some], width), width)
        a[some] += width
    coef, shift = np.zeros((len(live), int(order.max())), np.int64), np.zeros(len(live), np.int64)
    for i in np.flatnonzero(fixed[live]):
        coef[i, : order[i]] = FIXED[order[i]]
    lin = np.flatnonzero(linear[live])
    precision = get(a[lin], 4) + 1
    shift[lin] = get(a[lin] + 4, 5)
    a[lin] += 9
    for j in range(int(order[lin].max(initial=0))):
        some = order[lin] > j
        coef[lin[some], j] = signed(get(a[lin[some]], precision[some]), precision[some])
        a[lin[some]] += precision[some]
    wide = get(a, 2)  # 4- or 5-bit Rice parameters
    if (wide > 1).any():
        raise Corrupt("reserved residual method")
    parts = get(a + 2, 4)
    a += 6
    each = n >> parts

    # residuals, one sample of every stream at a time; the streams still open are a prefix
    turn = np.argsort(-n, kind="stable")
    a, n, order, x, coef, shift, wide, each, live = a[turn], n[turn], order[turn], x[turn], coef[turn], shift[turn], wide[turn], each[turn], live[turn]
    k = np.zeros(len(a), np.int64)
    longest, least, most = int(n[0]), int(order.min()), int(order.max())
    open_ = (len(n) - np.searchsorted(n[::-1], np.arange(1, longest + 1), "left")).tolist()
    starts = {i for size, e in set(zip(n.tolist(), each.tolist())) for i in range(0, size, e)} | set(order.tolist())
    begin, one, ks = (np.zeros((longest, len(a)), np.int32) for _ in range(3))
    for i in range(least, longest):
        m = open_[i]
        if i in starts:
            new = np.flatnonzero((order[:m] == i) | (i > order[:m]) & (i % each[:m] == 0))
            for w in (0, 1):
                some = new[wide[new] == w]
                if len(some):
                    k[some] = get(a[some], 4 + w)
                    if (k[some] == (15, 31)[w]).any():
                        raise Corrupt("escaped partitions are not supported")
                    a[some] += 4 + w
        lane = slice(m) if i >= most else np.flatnonzero(order[:m] <= i)
        begin[i, lane] = b = a[lane]
        one[i, lane] = c = next_one[b]
        ks[i, lane] = k[lane]
        a[lane] = c + 1 + k[lane]
    p = one + 1
    low = (words[p >> 3] << (p & 7) & 0xFFFFFFFF) >> (32 - ks)
    value = (one - begin) << ks | low
    y = x.T + ((value >> 1) ^ -(value & 1))

    bent = np.flatnonzero(coef.any(axis=1))  # the others are their residuals
    if len(bent):
        z, order, shift, back = y[:, bent], order[bent], shift[bent], coef[bent][:, ::-1].T.copy()
        depth = len(back)
        z = np.concatenate((np.zeros((depth, len(bent)), np.int64), z))
        for i in range(longest):
            m = min(int(np.searchsorted(bent, open_[i])), len(bent))
            guess = np.einsum("jl,jl->l", back[:, :m], z[i : i + depth, :m]) >> shift[:m]
            if i < most:
                guess[order[:m] > i] = 0
            z[i + depth, :m] += guess
        y[:, bent] = z[depth:]
    out[live] = y.T
    at[live] = a
    return out, at


def views(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of the data, the place of the next 1 from each, and the 32 bits from each byte."""
    bits = np.concatenate((np.unpackbits(data), np.zeros(64, np.uint8)))
    next_one = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    next_one = np.minimum.accumulate(next_one[::-1])[::-1]
    padded = np.concatenate((data, np.zeros(12, np.uint8))).astype(np.int64)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    return bits, next_one, words


def decode(streams: list[bytes], window: int = WINDOW) -> tuple[list[np.ndarray], list[list[tuple[int, int, int]]]]:
    """Samples of every stream, and its PCM blocks as (first sample, samples, byte offset of the frame).

    Decoding enters streams at many seek points at once, about ``window`` samples at a time, and goes on from each to the next. Header and frame
    checksums, the seek table, gaps between frames and the MD5 of the samples are checked.
    """
    infos = [metadata(s) for s in streams]
    frames: list[list[tuple[int, int, int, np.ndarray]]] = [[] for _ in streams]
    held, size = [], 0  # stream, first byte, byte after the last, next sample, sample to stop at
    for i, (info, begin) in enumerate(infos):
        points = sorted({(0, 0), *(p for p in info["seek"] if p[0] < info["samples"])})
        for (sample, byte), (stop, close) in zip(points, [*points[1:], (info["samples"], len(streams[i]) - begin)]):
            if sample < stop:
                held.append((i, begin + byte, begin + close, sample, stop))
                size += stop - sample
                if size >= window:
                    enter(streams, infos, held, frames)
                    held, size = [], 0
    if held:
        enter(streams, infos, held, frames)
    samples, blocks = [], []
    for own, (info, _) in zip(frames, infos):
        own.sort(key=lambda f: f[0])
        if sum(f[1] for f in own) != info["samples"] or any(a[0] + a[1] != b[0] for a, b in zip(own, own[1:])):
            raise Corrupt("samples are missing")
        x = np.concatenate([f[3] for f in own]) if own else np.zeros(0, np.int16)
        size = -(-info["bits"] // 8)
        if info["md5"] != bytes(16) and hashlib.md5(x.astype(f"<i{size}").tobytes()).digest() != info["md5"]:
            raise Corrupt("MD5 of the samples")
        samples.append(x)
        blocks.append([f[:3] for f in own])
    return samples, blocks


def enter(streams: list[bytes], infos: list[tuple[dict, int]], held: list[tuple[int, int, int, int, int]], frames: list[list[tuple[int, int, int, np.ndarray]]]) -> None:
    """Decode the stretches ``held`` between seek points, adding to each stream's ``frames``."""
    ranges: dict[int, list[int]] = {}
    for i, start, close, _, _ in held:
        own = ranges.setdefault(i, [start, close])
        own[0], own[1] = min(own[0], start), max(own[1], close)
    off, total = {}, 0  # where byte 0 of each stream would be in the bytes at hand
    for i, (start, close) in ranges.items():
        off[i] = total - start
        total += max(0, close - start)
    data = np.frombuffer(b"".join(streams[i][start:close] for i, (start, close) in ranges.items()), np.uint8)
    if len(data) != total:
        raise Corrupt("a seek point is out of place")
    bits, next_one, words = views(data)
    lanes, spans = [[i, start, sample, stop] for i, start, _, sample, stop in held], []
    while lanes:
        heads = [frame_header(streams[i], at, infos[i][0]["block"]) for i, at, _, _ in lanes]
        where = np.array([(off[lane[0]] + h[2]) * 8 for lane, h in zip(lanes, heads)], np.int64)
        if len({infos[lane[0]][0]["bits"] for lane in lanes}) > 1:
            raise Corrupt("streams of one batch differ in bits a sample")
        try:
            out, end = subframes(bits, next_one, words, where, np.array([h[1] for h in heads], np.int64), infos[lanes[0][0]][0]["bits"])
        except IndexError:
            raise Corrupt("a frame is cut short") from None
        more = []
        for r, (lane, (first, size, _)) in enumerate(zip(lanes, heads)):
            i, at, sample, stop = lane
            close = -(-int(end[r]) // 8) + 2 - off[i]
            if first != sample or close > ranges[i][1]:
                raise Corrupt("a frame is out of place or cut short")
            spans.append((off[i] + at, close - 2 - at, int.from_bytes(streams[i][close - 2 : close], "big")))
            frames[i].append((first, size, at - infos[i][1], out[r, :size].astype(np.int16 if infos[i][0]["bits"] <= 16 else np.int32)))
            if sample + size < stop:
                more.append([i, close, sample + size, stop])
        lanes = more
    at, size, crc = np.array(spans).T
    if (crc16(data, at, size) != crc).any():
        raise Corrupt("frame checksum")


def excerpt(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples ``first`` to ``first + n`` of one stream, decoding from the last seek point before them; no other frame is read."""
    info, begin = metadata(stream)
    stop = min(first + n, info["samples"])
    sample, byte = max((p for p in [(0, 0), *info["seek"]] if p[0] <= first), default=(0, 0))
    at, start, parts = begin + byte, sample, []
    data = np.frombuffer(stream, np.uint8)
    while sample < stop:
        own = frame_header(stream, at, info["block"])
        most = min(len(stream), at + 16 + (own[1] + 64) * 4)
        bits, next_one, words = views(data[at:most])
        out, end = subframes(bits, next_one, words, np.array([(own[2] - at) * 8]), np.array([own[1]]), info["bits"])
        close = at + -(-int(end[0]) // 8)
        if int(crc16(data, np.array([at]), np.array([close - at]))[0]) != int.from_bytes(stream[close : close + 2], "big"):
            raise Corrupt("frame checksum")
        parts.append(out[0, : own[1]])
        at, sample = close + 2, sample + own[1]
    return np.concatenate(parts)[first - start : stop - start] if parts else np.zeros(0, np.int64)
