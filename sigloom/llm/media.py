"""Media columns: payloads in AVI motion-JPEG, its RIFF reader, an intra-frame decoder and shot detection.

A payload byte is one grey 8x8 block whose only coefficient is its DC term, quantised by 8, so every
baseline decoder gives the byte back exactly.  The DC code used for writing gives category ``s`` a code
of ``9 - s`` bits; code and magnitude then always fill nine bits and the end-of-block code a tenth, and
whole frames are packed and unpacked by array arithmetic.  Frames of other encoders (baseline Huffman,
grey or colour, any sampling) take the general decoder.

Null texts count as empty; an empty payload is one row of 64 zero bytes.  Rows repeat in the output as
often as in the input; null doc_ids stay null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from sigloom.llm.common import arrow_pass

#: Blocks in a row of a frame, rows of a frame, frames a second.
COLUMNS, ROWS, FPS = 64, 16, 25
UNIT = 64

#: The order in which a JPEG block stores its 64 coefficients (fixed values).
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]


def _words() -> np.ndarray:
    """The ten bits of a block, by DC difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # canonical: 0, 10, 110, ...
        out[d + 255] = (((code << s) | (d if d > 0 else d + (1 << s) - 1 if d else 0)) << 1)
    return out


WORDS = _words()
DIFFS = np.zeros(1024, np.int16)
DIFFS[WORDS] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=64)
def jpeg_head(width: int, height: int) -> bytes:
    """All of a frame before its entropy-coded data."""
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15) + b"\x00"
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + dc)
        + _segment(0xC4, b"\x10" + ac)
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI of ``payload``, whose length is a positive multiple of 64."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    rows = min(ROWS, len(payload) // UNIT)
    each = rows * COLUMNS
    n = -(-len(payload) // each)
    samples = np.zeros(n * each, np.int16)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    samples = samples.reshape(n, each) - 128
    diff = np.diff(samples, axis=1, prepend=np.zeros((n, 1), np.int16))
    w = WORDS[diff + 255].reshape(-1, 4).astype(np.uint64)
    v = (w[:, 0] << 30) | (w[:, 1] << 20) | (w[:, 2] << 10) | w[:, 3]
    packed = v.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size = each * 10 // 8
    head = jpeg_head(8 * COLUMNS, 8 * rows)
    frames = [head + packed[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(n)]
    return mux_avi(frames, 8 * COLUMNS, 8 * rows, f"payload={len(payload)}")


def mux_avi(frames: list[bytes], width: int, height: int, comment: str = "") -> bytes:
    """An AVI with one video stream of JPEG frames and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment.encode() + b"\x00"))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(data: bytes) -> dict:
    """Frames by the RIFF index (by the movi list where there is none), frame time and comment of an AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"us": 1_000_000 // FPS, "comment": "", "index": [], "movi": None, "list": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    out["movi"] = body
                walk(body + 4, min(end, body + n))
            elif name == b"avih":
                out["us"] = struct.unpack_from("<I", data, body)[0] or out["us"]
            elif name == b"ICMT":
                out["comment"] = data[body : body + n].split(b"\x00")[0].decode("utf-8", "replace")
            elif name == b"idx1":
                out["index"] = [struct.unpack_from("<4sIII", data, i) for i in range(body, body + n - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                out["list"].append((body, n))
            at = body + n + (n & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    places = out["list"]
    if out["index"] and out["movi"] is not None:
        own = [(at, n) for name, _, at, n in out["index"] if name[2:] in (b"dc", b"db")]
        # offsets count from the movi list or, with some writers, from the start of the file
        base = out["movi"] if own and data[out["movi"] + own[0][0] :][:4] == out["index"][0][0] else 0
        places = [(base + at + 8, n) for at, n in own]
    return {"frames": [data[a : a + n] for a, n in places], "us": out["us"], "comment": out["comment"]}


def _head_of(frame: bytes) -> int:
    """Where the entropy-coded data of a JPEG frame begins."""
    at = 2
    while frame[at] == 0xFF:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + n
        if marker == 0xDA:
            return at
    raise ValueError("no scan in the JPEG frame")


@lru_cache(maxsize=64)
def _tables(head: bytes) -> dict:
    out: dict = {"q": {}, "h": {}, "ri": 0}
    at = 2
    while at < len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, p = head[at + 4 : at + 2 + n], 0
        if marker == 0xDB:
            while p < len(body):
                wide = body[p] >> 4
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.float64)
                out["q"][body[p] & 15] = q
                p += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            while p < len(body):
                counts, total = body[p + 1 : p + 17], sum(body[p + 1 : p + 17])
                code, codes, s = 0, {}, p + 17
                for length, c in enumerate(counts, 1):
                    for _ in range(c):
                        codes[length, code] = body[s]
                        code, s = code + 1, s + 1
                    code <<= 1
                out["h"][body[p]] = codes
                p += 17 + total
        elif marker in (0xC0, 0xC1):
            _, out["height"], out["width"], c = struct.unpack_from(">BHHB", body)
            out["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(c)}
        elif marker == 0xDD:
            out["ri"] = struct.unpack(">H", body)[0]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
            raise ValueError("only baseline JPEG frames are read")
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        at += 2 + n
    return out


def decode_jpeg(frame: bytes) -> np.ndarray:
    """The first component (grey or luma) of a baseline frame, as pixels."""
    start = _head_of(frame)
    t = _tables(frame[:start])
    data = frame[start : frame.rindex(b"\xff\xd9")] if b"\xff\xd9" in frame[start:] else frame[start:]
    parts = t["parts"]
    hm, vm = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(t["scan"]) == 1:
        only = t["scan"][0][0]
        parts = {only: (1, 1, parts[only][2])}
        hm = vm = 1
    mx, my = -(-t["width"] // (8 * hm)), -(-t["height"] // (8 * vm))
    first = t["scan"][0][0]
    fh, fv, fq = parts[first]
    coefs = np.zeros((my * fv, mx * fh, 64))
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in _split_restarts(data)] if t["ri"] else [data.replace(b"\xff\x00", b"\xff")]
    per = t["ri"] or mx * my
    for k, piece in enumerate(pieces):
        bits, at, n = int.from_bytes(piece, "big"), 0, 8 * len(piece)

        def take(count: int) -> int:
            nonlocal at
            at += count
            return (bits >> (n - at)) & ((1 << count) - 1)

        def symbol(codes: dict) -> int:
            code = length = 0
            while length < 16:
                code, length = (code << 1) | take(1), length + 1
                if (length, code) in codes:
                    return codes[length, code]
            raise ValueError("bad Huffman code")

        def value(s: int) -> int:
            v = take(s) if s else 0
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        pred = dict.fromkeys(parts, 0)
        for m in range(k * per, min((k + 1) * per, mx * my)):
            for c, tables in t["scan"]:
                h, v, _ = parts[c]
                for b in range(h * v):
                    block = np.zeros(64)
                    pred[c] += value(symbol(t["h"][tables >> 4]))
                    block[0], i = pred[c], 1
                    while i < 64:
                        rs = symbol(t["h"][16 | (tables & 15)])
                        if rs == 0:
                            break
                        i += rs >> 4
                        if rs & 15:
                            block[ZIGZAG[i]] = value(rs & 15)
                        i += 1
                    if c == first:
                        coefs[m // mx * v + b // h, m % mx * h + b % h] = block
    q = np.zeros(64)
    q[ZIGZAG] = t["q"][fq]
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    blocks = (coefs * q).reshape(*coefs.shape[:2], 8, 8)
    pixels = np.einsum("xu,abuv,yv->axby", basis, blocks, basis).reshape(coefs.shape[0] * 8, coefs.shape[1] * 8)
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)[: t["height"], : t["width"]]


def _split_restarts(data: bytes) -> list[bytes]:
    out, start = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            out.append(data[start:i])
            start = i + 2
    return [*out, data[start:]]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples by frame: one for each 8x8 block (its mean, exact for frames of ``encode_avi``)."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    start = _head_of(frames[0])
    head = frames[0][:start]
    t = _tables(head)
    own = head == jpeg_head(t["width"], t["height"])
    each = (t["width"] // 8) * (t["height"] // 8)
    if own and all(f.startswith(head) for f in frames):
        scans = b"".join(f[start:-2].replace(b"\xff\x00", b"\xff") for f in frames)
        if len(scans) == len(frames) * each * 10 // 8:
            p = np.zeros((len(scans) // 5, 8), np.uint8)
            p[:, 3:] = np.frombuffer(scans, np.uint8).reshape(-1, 5)
            v = p.reshape(-1).view(">u8").astype(np.uint64)
            w = np.stack([(v >> s) & 1023 for s in (30, 20, 10, 0)], axis=1)
            return (np.cumsum(DIFFS[w].reshape(len(frames), each), axis=1, dtype=np.int16) + 128).astype(np.uint8)
    out = []
    for f in frames:
        x = decode_jpeg(f)
        x = x[: x.shape[0] // 8 * 8, : x.shape[1] // 8 * 8]
        out.append(np.rint(x.reshape(x.shape[0] // 8, 8, -1, 8).mean(axis=(1, 3))).astype(np.uint8).reshape(-1))
    return np.stack(out)


def shots(samples: np.ndarray, window: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """First and last frame of each shot: a cut is where the histogram difference to the frame before
    is over ``least`` and over mean + ``factor`` deviations of the differences around it."""
    n = len(samples)
    if n < 2:
        return [(0, n - 1)] if n else []
    hist = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16) / samples.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (diff, diff * diff))
    lo, hi = np.maximum(np.arange(n - 1) - window, 0), np.minimum(np.arange(n - 1) + window + 1, n - 1)
    # the value itself is left out of its surroundings
    k = np.maximum(hi - lo - 1, 1)
    mean = (total[hi] - total[lo] - diff) / k
    spread = np.sqrt(np.maximum((square[hi] - square[lo] - diff * diff) / k - mean * mean, 0))
    cuts = np.flatnonzero(diff > np.maximum(least, mean + factor * spread)) + 1
    edges = [0, *cuts.tolist(), n]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def read_back(media: bytes) -> tuple[bytes, list[tuple[int, int]], str]:
    """Payload and shots of stored media, and a feature of them: time and mean level of each shot."""
    avi = parse_avi(media)
    samples = decode_frames(avi["frames"])
    n = int(avi["comment"].removeprefix("payload=")) if avi["comment"].startswith("payload=") else samples.size
    cuts = shots(samples)
    return samples.tobytes()[:n], cuts, ",".join(f"{a * avi['us'] // 1000}-{(b + 1) * avi['us'] // 1000}:{samples[a : b + 1].mean():.3f}" for a, b in cuts)


def pad(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with zero bytes up to a positive multiple of 64, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\x00"), len(raw)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, media)``: the AVI of each text."""
    kind = docs.schema[key].dataType.simpleString()
    return arrow_pass(docs.select(key, text), lambda c: {key: c[key], "media": [encode_avi(pad(t)[0]) for t in c[text]]}, f"{key} {kind}, media binary")


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows ``(key, clip, first_frame, last_frame, start_ms, end_ms)`` of AVI blobs; a null blob has none."""
    kind = media.schema[key].dataType.simpleString()

    def work(c: dict[str, list]) -> dict[str, list]:
        out: list[tuple] = []
        for k, blob in zip(c[key], c[column], strict=True):
            if blob is not None:
                avi = parse_avi(blob)
                for i, (a, b) in enumerate(shots(decode_frames(avi["frames"]))):
                    out.append((k, i, a, b, a * avi["us"] / 1000, (b + 1) * avi["us"] / 1000))
        names = (key, "clip", "first_frame", "last_frame", "start_ms", "end_ms")
        return {n: [r[i] for r in out] for i, n in enumerate(names)}

    return arrow_pass(media.select(key, column), work, f"{key} {kind}, clip int, first_frame int, last_frame int, start_ms double, end_ms double")


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document; media are written and read back within the pass."""

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_shots")}
        for text in c["text"]:
            payload, n = pad(text)
            media = encode_avi(payload)
            back, cut, feature = read_back(media)
            values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(cut))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return {"doc_id": c["doc_id"], **out}

    return arrow_pass(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_shots int")
