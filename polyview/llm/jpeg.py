"""A small JPEG codec: lossless (SOF3) coding of 8-bit grey rows, and decoding of SOF3 and baseline SOF0 frames.

The encoder's Huffman table gives category s a code of 9 - s bits, so that code and extra bits of any
difference always take nine bits together.  It is an ordinary table that any decoder of lossless
JPEG can use, and it lets whole blocks of frames be packed and unpacked with array operations.
Frames with any other table go through the general bit-by-bit decoder.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 64
_D = np.arange(-255, 256)
_S = np.array([abs(int(d)).bit_length() for d in _D])
#: difference + 255 -> nine bits: 8 - s ones, a zero, s extra bits.
ENCODE = ((((1 << (8 - _S)) - 1) << (_S + 1)) | np.where(_D > 0, _D, _D + (1 << _S) - 1)).astype(np.uint16)
DECODE = np.zeros(512, np.uint8)
DECODE[ENCODE] = _D & 255
_SHIFT = np.arange(8, dtype=np.uint16)
# Zigzag order of the 64 coefficients of a block (row * 8 + column), from the rule of the anti-diagonals.
ZIGZAG = np.array([r * 8 + c for d in range(15) for r, c in (lambda x: x if d % 2 else x[::-1])([(i, d - i) for i in range(8) if 0 <= d - i < 8])])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, width: int = WIDTH) -> bytes:
    """SOI, DHT, SOF3 and SOS of a lossless grey frame with predictor 1 (left)."""
    dht = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    sof = struct.pack(">BHHB", 8, rows, width, 1) + bytes([1, 0x11, 0])
    sos = bytes([1, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + _segment(0xC4, dht) + _segment(0xC3, sof) + _segment(0xDA, sos)


def encode_frames(samples: np.ndarray, rows: int) -> list[bytes]:
    """Frames of ``rows`` lines each (the last may have fewer) from lines of WIDTH samples."""
    lines = samples.astype(np.int16)
    diff = np.empty_like(lines)
    diff[:, 1:] = lines[:, 1:] - lines[:, :-1]
    diff[1:, 0] = lines[1:, 0] - lines[:-1, 0]
    diff[::rows, 0] = lines[::rows, 0] - 128
    codes = ENCODE[diff + 255].reshape(-1, 8)
    packed = np.zeros((len(codes), 9), np.uint8)
    packed[:, :8] = codes >> (1 + _SHIFT)
    packed[:, 1:] |= ((codes << (7 - _SHIFT)) & 255).astype(np.uint8)
    raw, per, out = packed.tobytes(), WIDTH // 8 * 9, []
    whole = header(rows)
    for at in range(0, len(lines), rows):
        n = min(rows, len(lines) - at)
        out.append((whole if n == rows else header(n)) + raw[at * per : (at + n) * per].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def parse(frame: bytes) -> dict:
    """Markers of a JPEG image: size, components, tables, scan data (stuffing removed)."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, out = 2, {"dc": {}, "ac": {}, "q": {}, "restart": 0}
    while True:
        if frame[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            out["kind"] = marker
            precision, out["rows"], out["width"], n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are supported")
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                n = sum(counts)
                out["ac" if body[i] >> 4 else "dc"][body[i] & 15] = (counts, body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                n = 64 * (1 + wide)
                out["q"][body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + n
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            n = body[0]
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            out["predictor"] = body[1 + 2 * n]
            break
    end = frame.rfind(b"\xff\xd9")
    data = frame[at : end if end >= at else len(frame)]
    if out["restart"]:
        raise ValueError("restart intervals are not supported")
    out["data"] = data.replace(b"\xff\x00", b"\xff")
    return out


def _codes(table) -> dict[tuple[int, int], int]:
    """Canonical Huffman codes: (length, code) -> symbol."""
    counts, symbols = table
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8)).tolist()
        self.at = 0

    def symbol(self, codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def value(self, n: int) -> int:
        """``n`` extra bits as a signed difference."""
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _constant(p: dict) -> bool:
    """Whether every symbol of a lossless frame takes nine bits as the encoder's do."""
    counts, symbols = p["dc"][p["scan"][0][1]]
    return p["kind"] == 0xC3 and p["predictor"] == 1 and p["width"] % 8 == 0 and bytes(counts[:9]) == bytes([1] * 9) and bytes(symbols) == bytes(range(8, -1, -1))


def _undo(lines: np.ndarray, rows: int) -> np.ndarray:
    """Samples from differences (modulo 256) of frames of ``rows`` lines, the last maybe shorter."""
    first = lines[:, 0]
    first[::rows] += 128
    for at in range(0, len(lines), rows) if len(lines) % rows else ():
        first[at : at + rows] = np.cumsum(first[at : at + rows], dtype=np.uint8)
    if not len(lines) % rows:
        lines[:, 0] = np.cumsum(first.reshape(-1, rows), axis=1, dtype=np.uint8).ravel()
    return np.cumsum(lines, axis=1, dtype=np.uint8)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Grey planes (first component) of intra frames, in order."""
    out: list[np.ndarray] = []
    seen: dict[bytes, tuple[dict, int]] = {}
    run: list[bytes] = []
    shape: tuple[int, int] | None = None

    def flush():
        if run:
            rows, width = shape
            b = np.frombuffer(b"".join(run), np.uint8).reshape(-1, 9)
            codes = (((b[:, :8].astype(np.uint16) << 8) | b[:, 1:]) >> (7 - _SHIFT)) & 511
            samples = _undo(DECODE[codes].reshape(-1, width), rows)
            out.extend(samples[i : i + rows] for i in range(0, len(samples), rows))
            run.clear()

    for frame in frames:
        cut = frame.find(b"\xff\xda") + 10
        head = frame[:cut]
        if head not in seen:
            p = parse(frame)
            seen[head] = (p, _constant(p) if len(p["scan"]) == 1 else False)
        p, fast = seen[head]
        if fast:
            if shape != (p["rows"], p["width"]):
                flush()
                shape = (p["rows"], p["width"])
            run.append(frame[cut:-2].replace(b"\xff\x00", b"\xff"))
            continue
        flush()
        p = parse(frame)
        out.append(_lossless(p) if p["kind"] == 0xC3 else _baseline(p))
    flush()
    return out


def _lossless(p: dict) -> np.ndarray:
    """Any lossless frame of one component."""
    if len(p["scan"]) != 1:
        raise ValueError("only one component is supported")
    bits, codes = _Bits(p["data"]), _codes(p["dc"][p["scan"][0][1]])
    rows, width, kind = p["rows"], p["width"], p["predictor"]
    x = np.zeros((rows, width), np.int64)
    for r in range(rows):
        for c in range(width):
            a, b, d = (int(x[r, c - 1]) if c else 0), (int(x[r - 1, c]) if r else 0), (int(x[r - 1, c - 1]) if r and c else 0)
            if not r:
                guess = a if c else 128
            elif not c:
                guess = b
            else:
                guess = (0, a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[kind]
            x[r, c] = (guess + bits.value(bits.symbol(codes))) & 255
    return x.astype(np.uint8)


_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _baseline(p: dict) -> np.ndarray:
    """First component of a baseline frame (Huffman, 8-bit, sequential, any sampling)."""
    bits = _Bits(p["data"])
    parts = {i: (h, v, q) for i, h, v, q in p["parts"]}
    scan = [(i, *parts[i], _codes(p["dc"][dc]), _codes(p["ac"][ac])) for i, dc, ac in p["scan"]]
    if len(scan) == 1:
        scan = [(scan[0][0], 1, 1, *scan[0][3:])]
    hmax, vmax = max(s[1] for s in scan), max(s[2] for s in scan)
    across, down = -(-p["width"] // (8 * hmax)), -(-p["rows"] // (8 * vmax))
    first = scan[0]
    plane, last = np.zeros((down * first[2] * 8, across * first[1] * 8)), [0] * len(scan)
    for my in range(down):
        for mx in range(across):
            for k, (_, h, v, q, dc, ac) in enumerate(scan):
                for by in range(v):
                    for bx in range(h):
                        block = np.zeros(64)
                        last[k] += bits.value(bits.symbol(dc))
                        block[0], at = last[k], 1
                        while at < 64:
                            s = bits.symbol(ac)
                            if s == 0:
                                break
                            at += s >> 4
                            if s & 15:
                                block[ZIGZAG[at]] = bits.value(s & 15)
                            at += 1
                        if k == 0:
                            scaled = np.zeros(64)
                            scaled[ZIGZAG] = block[ZIGZAG] * p["q"][q]
                            y, x = (my * v + by) * 8, (mx * h + bx) * 8
                            plane[y : y + 8, x : x + 8] = _COS @ scaled.reshape(8, 8) @ _COS.T
    rows, width = -(-p["rows"] * first[2] // vmax), -(-p["width"] * first[1] // hmax)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:rows, :width]
