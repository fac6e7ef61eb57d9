"""Coded blocks from samples: a track is cut into blocks, and many blocks are folded at a time, sample by sample, each
with the state that a decoder will have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import bytes as by
from ..functions import samples as fn
from ..functions.lookups import IMA_MOVES, IMA_STEPS, MS_FACTORS, MS_PAIRS
from .adpcm import MOST_DELTA

STEPS, MOVES, FACTORS = (np.array(x, np.int64) for x in (IMA_STEPS, IMA_MOVES, MS_FACTORS))


def geometry(coding: str, channels: int, block_bytes: int | None = None) -> tuple[int, int]:
    """(bytes, frames) of a whole block; 256 bytes a channel where a coding leaves the choice. An impossible size is an error."""
    if channels < 1:
        raise ValueError("a block has one channel at least")
    fixed = {"ulaw": (2048 * channels, 2048), "alaw": (2048 * channels, 2048), "ima-qt": (34 * channels, 64)}
    if coding in fixed:
        if block_bytes not in (None, fixed[coding][0]):
            raise ValueError(f"blocks of {coding} have {fixed[coding][0]} bytes")
        return fixed[coding]
    if coding not in ("ima-wav", "ms-adpcm"):
        raise ValueError(f"not a block coding: {coding}")
    head, unit, first = (4, 4, 1) if coding == "ima-wav" else (7, 1, 2)
    size = block_bytes or 256 * channels
    left = size - head * channels
    if left <= 0 or left % (unit * channels):
        raise ValueError(f"{size} bytes can't be dealt out to {channels} channels")
    return size, left // channels * 2 + first


def _mean_move(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The mean absolute difference of neighbours, without its fraction; 0 of single samples. x: (blocks, channels, frames)."""
    inside = np.arange(1, x.shape[2]) < n[:, None, None]
    return np.where(inside, np.abs(np.diff(x)), 0).sum(2) // np.maximum(n - 1, 1)[:, None]


def _ima(x: np.ndarray, n: np.ndarray, p: np.ndarray, i: np.ndarray, first: int) -> np.ndarray:
    """The nibbles of samples from the first on; behind a block's own samples, what keeps the last value."""
    out = np.zeros((*x.shape[:2], x.shape[2] - first), np.uint8)
    for f in range(first, x.shape[2]):
        size = STEPS[i]
        gap = np.where(f < n[:, None], x[:, :, f], p) - p
        left, told, move = np.abs(gap), np.zeros_like(gap), size >> 3
        for bit in (4, 2, 1):
            part = size >> (2 - bit // 2)
            taken = left >= part
            left, told, move = left - part * taken, told + bit * taken, move + part * taken
        p = np.clip(np.where(gap < 0, p - move, p + move), -32768, 32767)
        i = np.clip(i + MOVES[told], 0, 88)
        out[:, :, f - first] = told + 8 * (gap < 0)
    return out


def _ima_wav(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    start = x[:, :, 0]
    index = np.abs(STEPS - _mean_move(x, n)[:, :, None]).argmin(2)
    nibbles = _ima(x, n, start, index, 1)
    head = np.stack([start & 255, start >> 8 & 255, index, 0 * index], 2)
    pairs = nibbles[:, :, ::2] | nibbles[:, :, 1::2] << 4
    turns = pairs.reshape(*pairs.shape[:2], -1, 4).transpose(0, 2, 1, 3)
    return np.concatenate([head.reshape(len(x), -1), turns.reshape(len(x), -1)], 1)


def _ima_qt(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    start = x[:, :, 0] & ~127
    index = np.abs(STEPS - _mean_move(x, n)[:, :, None]).argmin(2)
    nibbles = _ima(x, n, start, index, 0)
    word = (start & 0xFF80) | index
    head = np.stack([word >> 8, word & 255], 2)
    return np.concatenate([head, nibbles[:, :, ::2] | nibbles[:, :, 1::2] << 4], 2).reshape(len(x), -1)


def _ms(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    older, last = x[:, :, 0], np.where(n[:, None] > 1, x[:, :, 1], x[:, :, 0])
    step = np.clip(_mean_move(x, n) // 4, 16, 32767)
    half = lambda v: [v & 255, v >> 8 & 255]
    head = np.concatenate([0 * step, *[np.stack(half(v), 2).reshape(len(x), -1) for v in (step, last, older)]], 1)
    out = np.zeros((len(x), x.shape[2] - 2, x.shape[1]), np.int64)
    for f in range(2, x.shape[2]):
        gap = np.where(f < n[:, None], x[:, :, f], last) - last
        told = np.clip(np.sign(gap) * ((np.abs(gap) + step // 2) // step), -8, 7)
        last = np.clip(last + told * step, -32768, 32767)
        step = np.clip(FACTORS[told & 15] * step // 256, 16, MOST_DELTA)
        out[:, f - 2] = told & 15
    flat = out.reshape(len(x), -1)
    return np.concatenate([head, flat[:, ::2] << 4 | flat[:, 1::2]], 1)


def encode_blocks(samples: DataFrame, coding: str, channels: int = 1, block_bytes: int | None = None, key: str = "track", at: str = "frame", ch: str = "ch", x: str = "x") -> DataFrame:
    """(key, block, frames, data): the coded blocks of tracks of 16-bit samples, numbered from 0, with how many frames of
    the track each holds. coding: ulaw, alaw, ima-wav, ima-qt or ms-adpcm.

    A track's last block is padded in the ADPCM codings, in a way that holds the last value, and as short as its frames in
    the others. Blocks start anew, so they are made apart and no task holds more of a track. Positions count up by one
    from 0 in every channel; null samples and missing ones are 0, larger ones are clipped. Rows with a null key, position
    or channel, or a channel past the last, take no part. An empty table gives none; other columns go."""
    _, frames = geometry(coding, channels, block_bytes)
    own = samples.where(F.col(key).isNotNull() & (F.col(at) >= 0) & F.col(ch).between(0, channels - 1))
    value = F.least(F.greatest(F.coalesce(F.col(x), F.lit(0)), F.lit(-32768)), F.lit(32767)).cast("int")
    place = ((F.col(at) % frames) * channels + F.col(ch)).cast("int")
    law = {"ulaw": fn.ulaw_encode, "alaw": fn.alaw_encode}.get(coding)
    item = F.struct(place.alias("place"), (law(value) if law else value).cast("int").alias("v"))
    blocks = own.groupBy(key, F.floor(F.col(at) / frames).alias("block")).agg((F.max(F.col(at) % frames) + 1).cast("bigint").alias("frames"), F.collect_list(item).alias("items"))
    key_type = samples.schema[key].dataType
    arrow = to_arrow_type(key_type)
    silent = {"ulaw": 0xFF, "alaw": 0xD5}.get(coding, 0)
    coder = {"ima-wav": _ima_wav, "ima-qt": _ima_qt, "ms-adpcm": _ms}.get(coding)
    many = max(1, (1 << 20) // (frames * channels))  # blocks that are folded at a time

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, n = batch.column("items"), batch.column("frames").to_numpy()
        counts = np.diff(lists.offsets.to_numpy())
        items = lists.flatten()
        grid = np.full((batch.num_rows, frames * channels), silent, np.int64)
        grid[np.repeat(np.arange(batch.num_rows), counts), pc.struct_field(items, "place").to_numpy()] = pc.struct_field(items, "v").to_numpy()
        if coder:
            rows = coder(grid.reshape(-1, frames, channels).transpose(0, 2, 1), n).astype(np.uint8)
            data = [r.tobytes() for r in rows]
        else:
            data = [r[: k * channels].tobytes() for r, k in zip(grid.astype(np.uint8), n)]
        return pa.RecordBatch.from_arrays([batch.column(key).cast(arrow), batch.column("block"), batch.column("frames"), pa.array(data, pa.binary())], names=[key, "block", "frames", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, many):
                yield made(batch.slice(start, many))

    fields = [StructField(key, key_type), StructField("block", LongType()), StructField("frames", LongType()), StructField("data", BinaryType())]
    return blocks.mapInArrow(run, StructType(fields))


def coded_data(blocks: DataFrame, key: str = "track") -> DataFrame:
    """(key, frames, data): the blocks of each track as the bytes of its data chunk. Such a row is a file's content, so
    this is for tracks of files that are written whole; longer ones are written block by block."""
    whole = F.array_sort(F.collect_list(F.struct("block", "data")))
    return blocks.groupBy(key).agg(F.sum("frames").alias("frames"), F.concat_ws("", F.transform(whole, lambda b: F.hex(b["data"]))).alias("h")).select(key, "frames", F.unhex("h").alias("data"))


#: The format numbers of WAV files.
WAV_TAGS = {"ms-adpcm": 2, "alaw": 6, "ulaw": 7, "ima-wav": 17}


def coded_wav(blocks: DataFrame, coding: str, channels: int, rate: int, block_bytes: int | None = None, key: str = "track") -> DataFrame:
    """(key, frames, content): blocks of encode_blocks() as WAV files, with the frames that the last block really has in a
    fact chunk. Null (refused) where the samples don't fit a row (2 GiB)."""
    if coding not in WAV_TAGS or (coding in ("ima-wav", "ms-adpcm") and channels > 2):
        raise ValueError(f"WAV files have no {coding} of {channels} channels")
    size, frames = geometry(coding, channels, block_bytes)
    law = coding in ("ulaw", "alaw")
    align, per_second = (channels, rate * channels) if law else (size, rate * size // frames)
    head = b"".join(v.to_bytes(n, "little") for v, n in ((WAV_TAGS[coding], 2), (channels, 2), (rate, 4), (per_second, 4), (align, 2), (8 if law else 4, 2)))
    pairs = b"".join(v.to_bytes(2, "little", signed=True) for pair in MS_PAIRS for v in pair)
    own = {"ima-wav": frames.to_bytes(2, "little"), "ms-adpcm": frames.to_bytes(2, "little") + len(MS_PAIRS).to_bytes(2, "little") + pairs}.get(coding, b"")
    fmt = head + len(own).to_bytes(2, "little") + own
    chunk = lambda name, data: name + len(data).to_bytes(4, "little") + data
    body = F.concat(F.lit(b"WAVE" + chunk(b"fmt ", fmt) + b"fact" + (4).to_bytes(4, "little")), by.le_bytes(F.col("frames"), 4), F.lit(b"data"), by.le_bytes(F.length("data"), 4), F.col("data"), F.when(F.length("data") % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    content = by.let(body, lambda b: F.concat(F.lit(b"RIFF"), by.le_bytes(F.length(b), 4), b))
    return coded_data(blocks, key).select(key, "frames", F.when(F.length("data") < (1 << 31) - 256, content).alias("content"))
