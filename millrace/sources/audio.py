"""Speech examples: audio columns decoded to mono samples at one rate, in small batches."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 16_000
BATCH = 16  # rows decoded at once: samples are many times their compressed bytes
# Sample formats of a WAV file's header.
PCM, FLOAT, A_LAW, MU_LAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE


def _expanded(kind: int) -> np.ndarray:
    """The 256 sample values of a companded byte, within 1: a sign, three bits of exponent, four of mantissa."""
    code = np.arange(256, dtype=np.int32)
    code = ~code & 0xFF if kind == MU_LAW else code ^ 0x55
    power, low = code >> 4 & 7, code & 15
    if kind == MU_LAW:
        size = ((2 * low + 33) << power) - 33
        return (np.where(code & 0x80, -size, size) / 8192).astype(np.float32)
    size = np.where(power == 0, 2 * low + 1, (2 * low + 33) << np.maximum(power - 1, 0))
    return (np.where(code & 0x80, size, -size) / 4096).astype(np.float32)


def _samples(kind: int, width: int, raw: bytes) -> np.ndarray:
    if kind in (A_LAW, MU_LAW) and width == 1:
        return _expanded(kind)[np.frombuffer(raw, np.uint8)]
    if kind == FLOAT and width in (4, 8):
        return np.frombuffer(raw, f"<f{width}").astype(np.float32)
    if kind == PCM and width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if kind == PCM and width == 3:
        own = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((own[:, 0] << 8 | own[:, 1] << 16 | own[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    if kind == PCM and width in (2, 4):
        return np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    raise ValueError(f"a WAV file of format {kind} with {8 * width} bits a sample")


def wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a WAV file: whole numbers of 8 to 32 bits, floats, A-law and mu-law. Data beyond the file's end
    are cut to whole frames. Other bytes are an error."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError(f"no WAV file: it begins with {content[:12]!r}")
    at, head = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            head = struct.unpack_from("<HHIIHH", body)
            if head[0] == EXTENSIBLE and len(body) >= 26:
                head = (struct.unpack_from("<H", body, 24)[0], *head[1:])
        elif name == b"data" and head:
            kind, channels, rate, _, frame, bits = head
            if not channels or not frame or frame != channels * -(-bits // 8):
                raise ValueError(f"a WAV file with frames of {frame} bytes for {channels} channels of {bits} bits")
            samples = _samples(kind, frame // channels, body[: len(body) // frame * frame])
            return samples.reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else samples, rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without format or data")


def decode(payload: dict | bytes) -> tuple[np.ndarray, int]:
    """Mono samples (float32, within 1) and sampling rate of an audio field: a ready array with its rate, or the bytes of a WAV
    file, alone or as the member bytes. Channels are averaged. Neither is an error."""
    if isinstance(payload, dict):
        if payload.get("array") is not None:
            return np.asarray(payload["array"], np.float32), int(payload.get("sampling_rate") or RATE)
        if payload.get("bytes") is None:
            raise ValueError(f"the audio field has neither array nor bytes, only {sorted(payload)}")
        payload = payload["bytes"]
    return wav(payload)


@lru_cache(maxsize=16)
def _filters(up: int, down: int, zeros: int = 24) -> np.ndarray:
    """For each phase of an upsampled sample the weights of the samples around it: a low pass at the lower of both rates, cut
    by a Kaiser window after so many zeros on each side; each phase sums to 1."""
    reach = math.ceil(zeros * max(1.0, down / up))
    places = np.arange(-reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    low = 0.945 * min(1.0, up / down)
    window = np.i0(9.0 * np.sqrt(np.maximum(0.0, 1 - (places / (reach + 1)) ** 2))) / np.i0(9.0)
    weights = low * np.sinc(low * places) * window
    return weights / weights.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate, by a polyphase filter: every new sample is a weighted sum of the old ones around its time.
    Beyond the ends the signal is silent."""
    if rate == target or not len(samples):
        return np.asarray(samples, np.float32)
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    filters = _filters(up, down)
    reach = filters.shape[1] // 2
    padded = np.pad(np.asarray(samples, np.float64), (reach, reach + 1))
    count = -(-len(samples) * up // down)
    out = np.empty(count, np.float32)
    around = np.lib.stride_tricks.sliding_window_view(padded, filters.shape[1])
    for a in range(0, count, 1 << 15):  # windows of a stretch at a time
        places = np.arange(a, min(count, a + (1 << 15))) * down
        out[a : a + len(places)] = np.einsum("ij,ij->i", around[places // up], filters[places % up])
    return out


def examples(rows: DataFrame, audio: str = "audio", limit: int | None = None, resample: Callable[[np.ndarray, int, int], np.ndarray] | None = resample) -> DataFrame:
    """rows with their audio column as struct<array, sampling_rate> at 16 kHz, the first limit of them.

    Sixteen rows are decoded at a time. Samples at another rate go through resample(samples, from, to); with None they keep
    their rate. A null field stays null; every other column passes through. An error names the row by its other columns.
    """
    kept = rows if limit is None else rows.limit(limit)
    names = kept.columns
    ddl = ", ".join(f"`{c}` struct<array:array<float>,sampling_rate:int>" if c == audio else f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    kind = pa.struct([("array", pa.list_(pa.float32())), ("sampling_rate", pa.int32())])

    def one(payload) -> dict | None:
        if payload is None:
            return None
        samples, rate = decode(payload)
        if rate != RATE and resample is not None:
            samples, rate = resample(samples, rate, RATE), RATE
        return {"array": samples, "sampling_rate": rate}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index(audio)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                made = []
                for j, x in enumerate(part.column(k).to_pylist()):
                    try:
                        made.append(one(x))
                    except (ValueError, struct.error) as e:
                        row = {c: part.column(i)[j].as_py() for i, c in enumerate(names) if i != k}
                        raise ValueError(f"row {row}: {e}") from e
                made = pa.array(made, kind)
                yield pa.RecordBatch.from_arrays([made if j == k else part.column(j) for j in range(len(names))], names=names)

    return kept.mapInArrow(run, ddl)
