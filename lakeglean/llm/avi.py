"""Media columns: AVI files of motion JPEG, with shots found by adaptive histogram differences.

`to_avi` stores a payload as the samples of 24 x 24 grey frames, each a lossless JPEG (process 14, predictor 1, one
Huffman table, 8 bits) in a RIFF AVI with a movi list and an idx1 index. `read_avi` parses that index, decodes the intra
frames of a whole batch of files side by side (one sample of every frame a step), and `clips` gives a row for each shot.

Edge cases: a null or empty payload is one frame of bytes 255; any length is padded to whole frames; very long payloads
are coded by themselves; equal payloads, ties and repeated rows give equal files; a null file has null columns and no clips; an
empty table gives no rows; extra columns are left out, whatever their names. Lossless grey frames of other writers are
read by their own tables and sizes; a file of another coding, or whose index is missing or broken, raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, map_slices, record_batch, slices, texts

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
PAD = 255
#: Huffman code lengths of the difference categories 0 to 8, fixed; the codes are canonical in this order of lengths.
LENGTHS = {7: 2, 4: 2, 3: 3, 5: 3, 2: 3, 1: 4, 6: 5, 0: 6, 8: 7}
ORDER = sorted(LENGTHS, key=lambda k: LENGTHS[k])
PEEK = 15  # the longest code and its bits
#: Frames that are coded side by side at most.
BLOCK = 4096


def _codes() -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for k in ORDER:
        code <<= LENGTHS[k] - last
        out[k], last = (code, LENGTHS[k]), LENGTHS[k]
        code += 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits and their number for each difference + 255; and, by the next PEEK bits, difference * 16 + length."""
    bits, size, look = np.zeros(511, np.uint64), np.zeros(511, np.int64), np.zeros(1 << PEEK, np.int32)
    codes = _codes()
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = codes[k]
        extra = d if d > 0 else d + (1 << k) - 1
        bits[d + 255], size[d + 255] = (code << k) | (extra if k else 0), n + k
        low = int(bits[d + 255]) << (PEEK - n - k)
        look[low : low + (1 << (PEEK - n - k))] = d * 16 + n + k
    return bits, size, look


BITS, SIZE, LOOK = _tables()


def _head() -> bytes:
    """Everything before the coded samples of a frame: SOI, DHT, SOF3, SOS."""
    counts = [sum(n == i for n in LENGTHS.values()) for i in range(1, 17)]
    dht = bytes([0, *counts, *ORDER])
    sof = struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    sos = bytes([1, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + b"".join(b"\xff" + m + struct.pack(">H", len(x) + 2) + x for m, x in ((b"\xc4", dht), (b"\xc3", sof), (b"\xda", sos)))


HEAD, TAIL = _head(), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of frames (n, FRAME) of bytes."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    at = (d + 255).reshape(n, FRAME)
    size = SIZE[at]
    end = np.cumsum(size, axis=1)
    words = (end[:, -1] + 31) // 32 + 1  # and one more, so that no frame shares a word
    base = np.cumsum(words) - words
    start = (end - size + (base * 32)[:, None]).ravel()
    size = size.ravel()
    # each code goes into 64 bits that begin at a 32-bit word
    word = start >> 5
    high = BITS[at.ravel()] << (64 - size - (start & 31)).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    both = np.bitwise_or.reduceat(high, first)
    out = np.zeros(int(words.sum()) + 1, np.uint32)
    out[word[first]] = (both >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    raw = out.astype(">u4").view(np.uint8)
    lengths = (end[:, -1] + 7) // 8
    spare = (lengths * 8 - end[:, -1]).astype(np.int64)
    last = base * 4 + lengths - 1
    raw[last] |= ((1 << spare) - 1).astype(np.uint8)  # the rest of the last byte is ones
    stuffed = raw.tobytes()
    return [HEAD + stuffed[b : b + k].replace(b"\xff", b"\xff\x00") + TAIL for b, k in zip((base * 4).tolist(), lengths.tolist(), strict=True)]


@dataclass(frozen=True)
class Form:
    """How a lossless frame is coded: sides, and the categories of its Huffman table by code length, as in its headers."""

    height: int
    width: int
    table: bytes

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next 16 bits: category and code length."""
        category, length = np.zeros(1 << 16, np.uint8), np.full(1 << 16, 16, np.uint8)
        code, at = 0, 16
        for n in range(1, 17):
            for k in self.table[at : at + self.table[n - 1]]:
                category[code << (16 - n) : (code + 1) << (16 - n)], length[code << (16 - n) : (code + 1) << (16 - n)] = k, n
                code += 1
            at += self.table[n - 1]
            code <<= 1
        return category, length


def form_of(frame: bytes) -> tuple[Form, int]:
    """The form of a JPEG file, and where its coded samples begin; ValueError if it is not one lossless 8-bit grey scan of predictor 1."""
    at, table, sides = 2, None, None
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            table = body[1 : 17 + sum(body[1:17])]
        elif marker == 0xC3:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            sides = (height, width) if precision == 8 and n == 1 else None
        elif marker == 0xDA:
            if table is None or sides is None or body[3] != 1 or body[5] & 15:
                break
            return Form(*sides, table), at
    raise ValueError("a frame is not a lossless 8-bit grey JPEG of predictor 1 with its own table")


OWN = form_of(HEAD)[0]


def decode_frames(scans: list[bytes], form: Form = OWN) -> np.ndarray:
    """Frames (n, samples) of the coded samples, without stuffing, of n JPEG files of one form."""
    n = len(scans)
    lengths = np.array([len(s) for s in scans])
    raw = np.frombuffer(b"".join(scans) + bytes(8), np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = ((np.cumsum(lengths) - lengths) * 8).astype(np.int64)
    out = np.empty((form.height * form.width, n), np.int16)
    most = len(ahead) - 1
    for i in range(len(out)):
        here = ahead[np.minimum(at >> 3, most)]
        if form == OWN:
            found = LOOK[(here >> (32 - PEEK - (at & 7)).astype(np.uint32)) & ((1 << PEEK) - 1)]
            out[i] = found >> 4
            at += found & 15
        else:
            category, length = (t[(here >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF] for t in form.codes)
            at += length
            here = ahead[np.minimum(at >> 3, most)]
            k = category.astype(np.int64)
            bits = (here.astype(np.int64) >> (32 - k - (at & 7))) & ((1 << k) - 1)
            out[i] = np.where((k > 0) & (bits >> np.maximum(k - 1, 0) == 0), bits - (1 << k) + 1, bits)
            at += k
    d = np.ascontiguousarray(out.T).reshape(n, form.height, form.width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(n, -1)


def avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI of one MJPG stream, with an idx1 index."""
    pack = struct.pack

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    n, most = len(frames), max(map(len, frames))
    avih = pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        index.append(pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def frames_of(media: bytes) -> list[tuple[Form, bytes]]:
    """Form and coded samples, unstuffed, of each frame that the index names."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for _, _, offset, size in struct.iter_unpack("<4sIII", media[index[0] : index[0] + index[1]]):
        start = movi + offset + 8
        form, begin = (OWN, len(HEAD)) if media[start : start + len(HEAD)] == HEAD else form_of(media[start : start + size])
        out.append((form, media[start + begin : start + size - 2].replace(b"\xff\x00", b"\xff")))
    return out


def payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % FRAME or FRAME * (not data))


def encode(data: list[bytes]) -> list[bytes]:
    """An AVI for each of the payloads, which are multiples of FRAME."""
    samples = np.frombuffer(b"".join(data), np.uint8).reshape(-1, FRAME)
    coded = [f for s in range(0, len(samples), BLOCK) for f in encode_frames(samples[s : s + BLOCK])]
    out, at = [], 0
    for d in data:
        n = len(d) // FRAME
        out.append(avi(coded[at : at + n]))
        at += n
    return out


def decode(media: list[bytes]) -> Iterator[np.ndarray]:
    """The frames of each file, which has one size of frames; of a null none."""
    scans = [frames_of(m) if m is not None else [] for m in media]
    flat = [s for x in scans for s in x]
    found: list = [None] * len(flat)
    for form in dict.fromkeys(f for f, _ in flat):
        own = [i for i, (f, _) in enumerate(flat) if f == form]
        for s in range(0, len(own), BLOCK):
            rows = own[s : s + BLOCK]
            for i, frame in zip(rows, decode_frames([flat[i][1] for i in rows], form), strict=True):
                found[i] = frame
    at = 0
    for x in scans:
        if len({len(f) for f in found[at : at + len(x)]}) > 1:
            raise ValueError("frames of several sizes in one file")
        yield np.stack(found[at : at + len(x)]) if x else np.zeros((0, FRAME), np.uint8)
        at += len(x)


def shots(frames: np.ndarray, bins: int = 16, window: int = 8, factor: float = 2.0, least: float = 0.08) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and the histogram difference of each frame to the one before (the first has 0).

    A frame begins a shot if its difference is at least `least` and over mean + factor * deviation of the up to `window`
    differences before it in the file (the mean and deviation of none are 0).
    """
    n = len(frames)
    if not n:
        return [], np.zeros(0)
    per = 256 // bins
    hist = np.bincount((np.repeat(np.arange(n), frames.shape[1]) * bins + frames.ravel() // per), minlength=n * bins).reshape(n, bins)
    diff = np.r_[0.0, np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * frames.shape[1])]
    s1, s2 = np.r_[0.0, np.cumsum(diff)], np.r_[0.0, np.cumsum(diff * diff)]
    i = np.arange(n)
    lo = np.maximum(1, i - window)
    k = np.maximum(i - lo, 0)
    mean = np.divide(s1[i] - s1[np.minimum(lo, i)], k, out=np.zeros(n), where=k > 0)
    var = np.divide(s2[i] - s2[np.minimum(lo, i)], k, out=np.zeros(n), where=k > 0) - mean**2
    cut = (i > 0) & (diff >= least) & (diff > mean + factor * np.sqrt(np.maximum(var, 0)) + 1e-12)
    return [0, *np.flatnonzero(cut).tolist()], diff


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as an AVI."""

    def run(batch: pa.RecordBatch) -> dict:
        data = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(d) for d in data], "media": encode([payload(d) for d in data])}

    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary", most=2 << 20)


def read_avi(media: DataFrame) -> DataFrame:
    """What the stored files hold: payload sizes and digests, shots and timed clips as text, from (doc_id, n_bytes, media)."""

    def run(batch: pa.RecordBatch) -> dict:
        files = batch.column("media").to_pylist()
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")
        out: dict[str, list] = {k: [] for k in names}
        for m, frames in zip(files, decode(files), strict=True):
            if m is None:
                for k in names:
                    out[k].append(None)
                continue
            raw = frames.tobytes()
            first, diff = shots(frames)
            out["payload_bytes"].append(len(raw))
            out["payload_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["tail_crc32"].append(zlib.crc32(raw[-32:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            out["feature"].append(f"frames={len(frames)};shots={','.join(map(str, first))};peak={diff.max(initial=0):.4f}")
            out["clips"].append(",".join(f"{a}-{b}" for _, _, a, b in timed(first, len(frames))))
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | out

    return map_slices(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string", column="media", most=2 << 20)


def timed(first: list[int], n: int, fps: int = FPS) -> Iterator[tuple[int, int, int, int]]:
    """Frames [start, end) of each shot and their times in milliseconds."""
    for a, b in zip(first, [*first[1:], n][: len(first)], strict=True):
        yield a, b, a * 1000 // fps, b * 1000 // fps


CLIPS = "doc_id long, clip int, start_frame long, end_frame long, start_ms long, end_ms long, mean_level double"


def clips(media: DataFrame, fps: int = FPS) -> DataFrame:
    """A row for each shot: doc_id, clip, frames [start, end), times, mean grey level."""
    arrow = _arrow_schema(CLIPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            rows = []
            for doc, frames in zip(batch.column("doc_id").to_pylist(), decode(batch.column("media").to_pylist()), strict=True):
                first, _ = shots(frames)
                for c, (a, b, start, end) in enumerate(timed(first, len(frames), fps)):
                    rows.append((doc, c, a, b, start, end, float(frames[a:b].mean())))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows, strict=True), strict=True)), arrow)

    return media.select("doc_id", F.col("media").cast("binary").alias("media")).mapInArrow(run, CLIPS)
