"""Operator 4, media columns: telephony audio.

mu-law and A-law codes expand by lookup tables, IMA ADPCM decodes with numpy across blocks (one
step per sample position, all blocks at once), and decoded speech is stored as PCM at twice the
telephone rate. Audio columns hold RIFF/WAVE files.

A payload of bytes is stored losslessly as the codes of one of three formats, which its crc32
chooses: mu-law or A-law samples, one for each byte, or blocks of IMA ADPCM, a byte being two
4-bit codes after each block's header. What is stored is read back, decoded and resampled into a
PCM column, and features are computed from that column.

Defined cases: a null text is empty; an empty text is 64 zero bytes; equal texts have equal media
and features; null media give null results; repeated rows are encoded one by one; extra columns
are ignored. A row's media and PCM must fit one value each; rows are handled a few megabytes at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

UNIT = 64
RATE = 8000
#: Bytes of an ADPCM block: a header of four, then a unit of codes.
BLOCK = 4 + UNIT
#: Media bytes that are decoded at a time; a longer value is decoded alone.
PART = 1 << 20
FORMATS = {1: "pcm", 6: "alaw", 7: "mulaw", 0x11: "ima_adpcm"}
# IMA ADPCM, fixed values: step sizes, and how a code moves the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: Half-band filter for doubling the rate, over 16: what lies between two samples.
HALF = np.array([-1, 9, 9, -1], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((u & 15) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int64) ^ 0x55
    part, seg = (a & 15) << 4, a >> 4 & 7
    size = np.where(seg == 0, part + 8, (part + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def compress(pcm: np.ndarray, expand: np.ndarray) -> np.ndarray:
    """The code of expand whose sample is nearest to each 16-bit sample (the lower one of two)."""
    order = np.argsort(expand, kind="stable")
    level = expand[order].astype(np.int64)
    at = np.searchsorted(level, pcm.astype(np.int64))
    low, high = np.maximum(at - 1, 0), np.minimum(at, 255)
    return order[np.where(pcm - level[low] <= level[high] - pcm, low, high)].astype(np.uint8)


def _step(code: np.ndarray, value: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
    return value, np.clip(index + MOVES[code & 7], 0, 88)


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks of that many bytes (the last may be shorter)."""
    raw = np.frombuffer(data, np.uint8)
    rows = -(-len(raw) // block)
    if not rows:
        return np.empty(0, np.int16)
    raw = np.concatenate((raw, np.zeros(rows * block - len(raw), np.uint8))).reshape(rows, block)
    value = raw[:, :2].copy().view("<i2").reshape(-1).astype(np.int64)
    index = np.minimum(raw[:, 2], 88).astype(np.int64)
    codes = np.stack((raw[:, 4:] & 15, raw[:, 4:] >> 4), 2).reshape(rows, -1).astype(np.int64)
    out = np.empty((rows, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        value, index = _step(codes[:, k], value, index)
        out[:, k + 1] = value
    spare = rows * block - len(data)
    return out.reshape(-1)[: out.size - 2 * spare]


def adpcm_encode(pcm: np.ndarray, block: int) -> bytes:
    """Mono IMA ADPCM of 16-bit samples, all blocks side by side; the last block is filled up."""
    per = 2 * (block - 4) + 1
    rows = -(-len(pcm) // per)
    if not rows:
        return b""
    x = np.concatenate((pcm, np.full(rows * per - len(pcm), pcm[-1]))).reshape(rows, per).astype(np.int64)
    out = np.zeros((rows, block), np.uint8)
    value, index = x[:, 0].copy(), np.zeros(rows, np.int64)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(rows, 2)
    for k in range(1, per):
        step, gap = STEPS[index], x[:, k] - value
        code, size = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit in (4, 2, 1):
            on = size >= step
            code, size, step = code | np.where(on, bit, 0), np.where(on, size - step, size), step >> 1
        value, index = _step(code, value, index)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wave(data: bytes, kind: int = 7, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF/WAVE file."""
    pad = b"\0" * (len(data) & 1)
    fmt = struct.pack("<HHIIHHH", kind, 1, rate, rate * align if kind != 0x11 else rate // 2, align, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_parts(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block bytes and data of a RIFF/WAVE file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate, align = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return kind, rate, align, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def blocks_of(payload: bytes) -> bytes:
    """IMA ADPCM blocks whose codes are the payload's bytes (a multiple of the unit), each from silence."""
    out = np.zeros((len(payload) // UNIT, BLOCK), np.uint8)
    out[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return out.tobytes()


def payload_of(kind: int, data: memoryview, align: int) -> bytes:
    """The codes of an audio file's data, without ADPCM headers."""
    if kind != 0x11:
        return bytes(data)
    raw = np.frombuffer(data, np.uint8)
    full = len(raw) // align * align
    return raw[:full].reshape(-1, align)[:, 4:].tobytes() + raw[full + 4 :].tobytes()


def samples(parts: list[tuple[int, int, int, memoryview]]) -> list[np.ndarray]:
    """16-bit samples of several files (format, rate, block bytes, data). ADPCM blocks of one size are decoded
    side by side, whichever file they are from."""
    out: list = [None] * len(parts)
    adpcm: dict[int, list[int]] = {}
    for i, (kind, _, align, data) in enumerate(parts):
        if kind == 0x11:
            adpcm.setdefault(align, []).append(i)
        elif kind == 1:
            out[i] = np.frombuffer(data, "<i2")
        else:
            out[i] = (MULAW if kind == 7 else ALAW)[np.frombuffer(data, np.uint8)]
    for align, some in adpcm.items():
        # a file's last block may be shorter: it is filled up, and its spare samples go
        full = [-(-len(parts[i][3]) // align) * align for i in some]
        pcm = adpcm_decode(b"".join(bytes(parts[i][3]).ljust(n, b"\0") for i, n in zip(some, full, strict=True)), align)
        at = 0
        for i, n in zip(some, full, strict=True):
            k = n // align * (2 * (align - 4) + 1)
            out[i] = pcm[at : at + k - 2 * (n - len(parts[i][3]))]
            at += k
    return out


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then what the half-band filter finds after it (the ends held)."""
    x = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    n = len(pcm)
    mid = HALF[0] * x[:n] + HALF[1] * x[1 : n + 1] + HALF[2] * x[2 : n + 2] + HALF[3] * x[3 : n + 3]
    out = np.empty(2 * n, np.int16)
    out[::2], out[1::2] = pcm, np.clip((mid + 8) >> 4, -32768, 32767)
    return out


def features(pcm: np.ndarray) -> str:
    """Energy (mean square), peak, zero crossings and mean of decoded speech, in integers."""
    if not len(pcm):
        return "energy=0 peak=0 crossings=0 mean=0"
    x = pcm.astype(np.int64)
    return f"energy={int(x @ x) // len(x)} peak={int(np.abs(x).max())} crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))} mean={int(x.sum()) // len(x)}"


def store_payload(payload: bytes) -> bytes:
    """A WAVE file that holds the payload (a multiple of the unit) as the codes of one of three formats."""
    kind = (7, 6, 0x11)[zlib.crc32(payload) % 3]
    return wave(blocks_of(payload), kind, bits=4, align=BLOCK) if kind == 0x11 else wave(payload, kind)


def encode_text(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes (of the text), media: the padded UTF-8 bytes as a WAVE file's codes."""
    d = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch, "__text"):
                raw, sizes = raw.tobytes(), np.diff(offsets)
                full = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
                media = [store_payload(raw[a : a + n].ljust(f, b"\0")) for a, n, f in zip(offsets.tolist(), sizes.tolist(), full.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(media, pa.binary())], ["__id", "n_bytes", "media"])

    return d.mapInArrow(run, f"__id {d.schema['__id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("__id", id_col)


def _each(df: DataFrame, keep: list[str], value: str, fields: str, several) -> DataFrame:
    """keep and what several(values) returns, a tuple of fields for each value; null where the value is null.
    Values are handled together up to PART bytes."""
    d = df.select(*[F.col(c) for c in keep], F.col(value).alias("__value"))
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, lo = batch.column(len(keep)), 0
            size = np.cumsum([len(m.as_buffer()) if m.is_valid else 0 for m in col])
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART, "right")))
                own = [m.as_buffer().to_pybytes() if m.is_valid else None for m in col.slice(lo, hi - lo)]
                found = iter(several([m for m in own if m is not None]))
                rows = [(None,) * len(names) if m is None else next(found) for m in own]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], *[pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]], [*keep, *names])
                lo = hi

    return d.mapInArrow(run, f"{schema}, {fields}")


def describe(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """keep, and of the stored payload: payload_bytes, payload_sha256, tail_crc32 (its last unit); of the file:
    media_bytes, media_sha256; the speech: rate, pcm (decoded, at twice its rate, little-endian 16-bit), and the
    feature of that PCM."""

    def several(files: list[bytes]) -> Iterator[tuple]:
        parts = [wave_parts(m) for m in files]
        for m, (kind, rate, align, data), one in zip(files, parts, samples(parts), strict=True):
            payload, pcm = payload_of(kind, data, align), doubled(one).astype("<i2").tobytes()
            yield (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(),
                2 * rate, pcm, features(np.frombuffer(pcm, "<i2")),
            )

    return _each(df, keep, media, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate long, pcm binary, feature string", several)


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(encode_text(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"]).drop("rate", "pcm")
