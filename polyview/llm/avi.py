"""AVI motion-JPEG: write and read RIFF files with an index, and find shots in decoded frames."""

from __future__ import annotations

import struct

import numpy as np

from . import jpeg

FPS = 25
ROWS = 16
#: Frames that are encoded or decoded at once; bounds memory, not the length of a file.
BLOCK = 1024


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, kind: bytes, body: bytes) -> bytes:
    return _chunk(name, kind + body)


def write_avi(payload: bytes, rows: int = ROWS, fps: int = FPS) -> bytes:
    """A motion-JPEG file whose grey samples are ``payload`` (a positive multiple of the line width)."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, jpeg.WIDTH)
    frames = [f for at in range(0, len(lines), BLOCK * rows) for f in jpeg.encode_frames(lines[at : at + BLOCK * rows], rows)]
    height, longest = min(rows, len(lines)), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, longest * fps, 0, 0x10, len(frames), 0, 1, longest, jpeg.WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), longest, -1, 0, 0, 0, jpeg.WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, jpeg.WIDTH, height, 1, 8, b"MJPG", jpeg.WIDTH * height, 0, 0, 0, 0)
    hdrl = _list(b"LIST", b"hdrl", _chunk(b"avih", avih) + _list(b"LIST", b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = _list(b"LIST", b"movi", b"".join(_chunk(b"00dc", f) for f in frames))
    return _list(b"RIFF", b"AVI ", hdrl + movi + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """Header fields and the encoded frames of the first video stream, by the index if there is one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    head, frames, index, movi = {}, [], None, None
    for name, at, size in _walk(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, a, s in _walk(data, at + 4, at + size):
                if n == b"avih":
                    f = struct.unpack("<10I", data[a : a + 40])
                    head |= {"frame_us": f[0], "frames": f[4], "width": f[8], "height": f[9]}
                elif n == b"LIST" and data[a : a + 4] == b"strl":
                    for m, b, _ in _walk(data, a + 4, a + s):
                        if m == b"strh" and "codec" not in head and data[b : b + 4] == b"vids":
                            head["codec"] = data[b + 4 : b + 8].decode("latin-1")
                            head["scale"], head["rate"] = struct.unpack("<II", data[b + 20 : b + 28])
        elif name == b"LIST" and kind == b"movi":
            movi = (at, at + size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        entries = [struct.unpack("<4sIII", data[i : i + 16]) for i in range(index[0], index[0] + index[1] - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        # Offsets count from the movi list's kind or from the start of the file.
        base = movi[0] if entries and data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        frames = [data[base + o + 8 : base + o + 8 + n] for _, _, o, n in entries]
    else:
        frames = [data[a : a + s] for n, a, s in _walk(data, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")]
    return head, frames


def decode(frames: list[bytes]):
    """Grey planes, a block of frames at a time."""
    for at in range(0, len(frames), BLOCK):
        yield jpeg.decode_frames(frames[at : at + BLOCK])


def histograms(planes: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """Share of samples by grey level, one row per frame."""
    sizes = np.array([p.size for p in planes])
    values = np.concatenate([p.ravel() for p in planes])
    at = np.repeat(np.arange(len(planes)) * bins, sizes) + values // (256 // bins)
    return np.bincount(at, minlength=len(planes) * bins).reshape(-1, bins) / sizes[:, None]


def shots(hist: np.ndarray, radius: int = 4, spread: float = 2.0, least: float = 0.3) -> list[tuple[int, int]]:
    """Clips [first, last + 1) of frames.

    A cut lies before frame i if the histogram difference there is at least ``least`` and above mean
    plus ``spread`` deviations of the differences within ``radius`` (its own left out), and no
    neighbour's is larger.
    """
    n = len(hist)
    if n < 2:
        return [(0, n)] if n else []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    pad = np.concatenate([np.zeros(radius), d, np.zeros(radius)])
    there = np.concatenate([np.zeros(radius), np.ones(len(d)), np.zeros(radius)])
    box = lambda x: np.convolve(x, np.ones(2 * radius + 1), "valid")
    count = np.maximum(box(there) - 1, 1)
    mean = (box(pad) - d) / count
    dev = np.sqrt(np.maximum((box(pad * pad) - d * d) / count - mean * mean, 0))
    left, right = np.concatenate([[0], d[:-1]]), np.concatenate([d[1:], [0]])
    cut = (d >= least) & (d > mean + spread * dev) & (d >= left) & (d > right)
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))
