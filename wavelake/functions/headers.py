"""Header fields of coded streams and track arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes as by
from .lookups import DEFAULT_MASKS, FORMATS, MPEG_BITRATES, MPEG_RATES, SPEAKERS


#: The longest MPEG frame.
MOST_FRAME_BYTES = 2880
#: The longest coded block, and the most channels of one.
MOST_BLOCK_BYTES, MOST_CHANNELS = 1 << 20, 64


def bits(b: Column, shift: int, mask: int) -> Column:
    return F.shiftright(b.cast("int"), shift).bitwiseAND(mask)


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _header_fields(b0: Column, b1: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """What the bits say; known: whether they use no reserved value."""
    version_bits, layer_bits = bits(b1, 3, 3), bits(b1, 1, 3)
    bitrate_index, rate_index = bits(b2, 4, 15), bits(b2, 2, 3)
    known = (b0 == 0xFF) & (bits(b1, 5, 7) == 7) & (version_bits != 1) & (layer_bits != 0) & (bitrate_index != 15) & (rate_index != 3)
    version = F.when(version_bits == 3, 1).when(version_bits == 2, 2).otherwise(25)
    layer = 4 - layer_bits
    index, at = F.least(bitrate_index, F.lit(14)), F.least(rate_index, F.lit(2))
    kbit = F.coalesce(*[F.when((F.when(version_bits == 3, 1).otherwise(2) == v) & (layer == k), _pick(rates, index)) for (v, k), rates in MPEG_BITRATES.items()])
    rate = F.coalesce(*[F.when(version == v, _pick(rates, at)) for v, rates in MPEG_RATES.items()])
    mode = bits(b3, 6, 3)
    side = F.when(layer != 3, 0).when(version_bits == 3, F.when(mode == 3, 17).otherwise(32)).otherwise(F.when(mode == 3, 9).otherwise(17))
    return {
        "known": known, "version": version, "layer": layer, "bitrate": kbit * 1000, "sample_rate": rate, "channels": F.when(mode == 3, 1).otherwise(2),
        "samples": F.when(layer == 1, 384).when((layer == 2) | (version_bits == 3), 1152).otherwise(576), "side_info": side, "mode": mode, "mode_extension": bits(b3, 4, 3), "emphasis": bits(b3, 0, 3),
        "crc_present": bits(b1, 0, 1) == 0, "padding": bits(b2, 1, 1) == 1, "private": bits(b2, 0, 1) == 1, "copyright": bits(b3, 3, 1) == 1, "original": bits(b3, 2, 1) == 1,
    }


def _frame_size(layer: Column, samples: Column, bitrate: Column, rate: Column, padding: Column) -> Column:
    """A layer I frame is whole slots of four bytes: divide before multiplying. 0: the free format."""
    pad = F.when(padding, 1).otherwise(0)
    return F.when(bitrate == 0, 0).when(layer == 1, (F.floor(12 * bitrate / rate) + pad) * 4).otherwise(F.floor(F.floor(samples / 8) * bitrate / rate) + pad)


def mpeg_header(b0: Column, b1: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """Fields of a 4-byte MPEG frame header; valid says whether it is one, and the others are null if not. A frame must
    fit 2,880 bytes and hold its header, checksum and side information; size 0 is the free format. For several fields
    at once take with_mpeg_header, which computes each step once."""
    f = _header_fields(b0, b1, b2, b3)
    size = _frame_size(*[f[k] for k in ("layer", "samples", "bitrate", "sample_rate", "padding")])
    valid = by.let(size, lambda s: f["known"] & (s <= MOST_FRAME_BYTES) & ((s == 0) | (s >= 4 + F.when(f["crc_present"], 2).otherwise(0) + f["side_info"])))
    valid = F.coalesce(valid, F.lit(False))
    flags = ("crc_present", "padding", "private", "copyright", "original")
    return {"valid": valid, **{k: F.when(valid, v if k in flags else v.cast("bigint")) for k, v in {**f, "frame_size": size}.items() if k != "known"}}


def with_mpeg_header(df: DataFrame, b0: str, b1: str, b2: str, b3: str) -> DataFrame:
    """df with the fields of mpeg_header as columns, each computed once."""
    bare = {k: v for k, v in _header_fields(*map(F.col, (b0, b1, b2, b3))).items()}
    out = df.withColumns({f"__{k}": v for k, v in bare.items()})
    out = out.withColumn("__size", _frame_size(*[F.col(f"__{k}") for k in ("layer", "samples", "bitrate", "sample_rate", "padding")]))
    valid = F.col("__known") & (F.col("__size") <= MOST_FRAME_BYTES) & ((F.col("__size") == 0) | (F.col("__size") >= 4 + F.when(F.col("__crc_present"), 2).otherwise(0) + F.col("__side_info")))
    out = out.withColumn("valid", F.coalesce(valid, F.lit(False)))
    names = {**{k: f"__{k}" for k in bare if k != "known"}, "frame_size": "__size"}
    kept = [F.when(F.col("valid"), F.col(c) if dict(out.dtypes)[c] == "boolean" else F.col(c).cast("bigint")).alias(k) for k, c in names.items()]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "valid", *kept)


def opus_toc(b: Column) -> dict[str, Column]:
    """Mode, bandwidth, frame size at 48 kHz, stereo and frame code of an Opus packet's first byte."""
    config = bits(b, 3, 31)
    low = config.bitwiseAND(3)
    mode = F.when(config < 12, "silk").when(config < 16, "hybrid").otherwise("celt")
    silk = _pick([480, 960, 1920, 2880], low)
    size = F.when(config < 12, silk).when(config < 16, F.when(config % 2 == 0, 480).otherwise(960)).otherwise(_pick([120, 240, 480, 960], low))
    silk_band = _pick_text(["NB", "MB", "WB"], F.least(F.shiftright(config, 2), F.lit(2)))
    celt_band = _pick_text(["NB", "WB", "SWB", "FB"], F.shiftright(config, 2).bitwiseAND(3))
    band = F.when(config < 12, silk_band).when(config < 14, "SWB").when(config < 16, "FB").otherwise(celt_band)
    return {"mode": mode, "bandwidth": band, "frame_size": size.cast("bigint"), "stereo": bits(b, 2, 1) == 1, "code": bits(b, 0, 3).cast("bigint")}


def _pick_text(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def duration(frames: Column, delay: Column, padding: Column, rate: Column) -> Column:
    """Seconds of a track without its delay and padding; -1 where its length or rate is not known."""
    known = frames.isNotNull() & (rate > 0)
    return F.when(known, F.greatest(frames - delay - padding, F.lit(0)) / F.when(rate > 0, rate)).otherwise(-1.0)


def layout_valid(mask: Column, channels: Column) -> Column:
    """There is a channel at least. A mask of 0 states nothing; any other names each channel."""
    return (channels > 0) & ((mask == 0) | (F.bit_count(mask) == channels))


def layout_channels(mask: Column, channels: Column) -> Column:
    """The speakers of a valid layout, by channel: the i-th set bit; an empty array where none are named."""
    names = F.array(*[F.when(F.shiftright(mask.cast("int"), i).bitwiseAND(1) == 1, s) for i, s in enumerate(SPEAKERS)])
    return F.when(layout_valid(mask, channels), F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def default_mask(channels: Column) -> Column:
    """The usual mask of 1 to 8 channels, else 0."""
    return F.coalesce(F.get(F.array(*map(F.lit, DEFAULT_MASKS)), (channels - 1).cast("int")), F.lit(0)).cast("bigint")


def bytes_for(fmt: str, channels: Column, frames: Column) -> Column:
    """Bytes of so many frames; DSD packs eight samples a byte, opaque data has a byte a frame."""
    if fmt == "opaque":
        return frames.cast("bigint")
    width = next(bits for name, bits, _, _ in FORMATS if name == fmt)
    return F.floor((channels * frames * width + 7) / 8).cast("bigint")


def opus_frames(granule: Column, pre_skip: Column) -> Column:
    """Frames of an Opus stream from its last granule; null where none is stated."""
    return F.greatest(granule - pre_skip, F.lit(0)).cast("bigint") * F.when(granule.isNotNull(), 1)


def length_source(header: dict[str, Column], stated: Column, counted: Column) -> Column:
    """Where the length of an MPEG stream comes from: stated by a tag, counted, estimated from a rate, or unknown."""
    return F.when(~header["valid"], "unknown").when(stated, "stated").when(counted, "counted").when(header["bitrate"] > 0, "estimated").otherwise("unknown")


def layout_offset(frame: Column, channel: Column, channels: Column, frames: Column, width: int, planar: bool) -> Column:
    """Where a sample of ``width`` bytes lies; frames is the length of its track."""
    return ((channel * frames + frame) if planar else (frame * channels + channel)) * width


def coded_geometry(coding: str, block: Column, channels: Column, stated: Column | None = None) -> dict[str, Column]:
    """result, block_bytes and block_frames of a coding; the last two are null unless result is OK. A block that can't be
    dealt out to its channels, or holds other than the stated frames (0: not stated), is CORRUPT."""
    if coding in ("ulaw", "alaw"):
        size, frames, fits = 2048 * channels, F.lit(2048), F.lit(True)
    elif coding == "ima-qt":
        size, frames, fits = 34 * channels, F.lit(64), F.lit(True)
    elif coding in ("ima-wav", "ms-adpcm"):
        head, unit, first = (4, 4, 1) if coding == "ima-wav" else (7, 1, 2)
        own = F.when(channels > 0, channels)
        size, frames = block, F.floor((block - head * channels) / own) * 2 + first
        fits = (block > head * channels) & (block <= MOST_BLOCK_BYTES) & ((block - head * channels) % (unit * own) == 0)
    else:
        raise ValueError(f"not a block coding: {coding}")
    if stated is not None:
        fits = fits & ((stated == 0) | (stated == frames))
    result = F.when(channels <= 0, "INVALID").when(channels > MOST_CHANNELS, "LIMIT").when(fits, "OK").otherwise("CORRUPT")
    return {"result": result, **{k: F.when(result == "OK", v.cast("bigint")) for k, v in (("block_bytes", size), ("block_frames", frames))}}


def coded_frames(coding: str, block: Column, channels: Column) -> Column:
    """Frames that a block of ``block`` bytes holds; null where its geometry is corrupt."""
    if coding in ("ulaw", "alaw"):
        return F.when(channels > 0, F.floor(block / F.when(channels > 0, channels))).cast("bigint")
    if coding == "ima-qt":
        return F.when(channels > 0, F.floor(block / F.when(channels > 0, 34 * channels)) * 64).cast("bigint")
    return coded_geometry(coding, block, channels)["block_frames"]


def tail_frames(coding: str, size: Column, block: Column, channels: Column) -> Column:
    """Frames that a last block of only ``size`` bytes yields; a whole one has those of the geometry."""
    own = F.when(channels > 0, channels)
    whole = coded_geometry(coding, block, channels)
    if coding in ("ulaw", "alaw"):
        part = F.floor(size / own)
    elif coding == "ima-qt":
        part = F.when(size >= 34 * own, 64).otherwise(0)
    elif coding == "ima-wav":
        part = F.when(size < 4 * own, 0).otherwise(1 + 8 * F.floor((size - 4 * own) / (4 * own)))
    else:
        part = F.when(size < 7 * own, 0).otherwise(2 + F.floor((size - 7 * own) * 2 / own))
    return F.when(size <= 0, 0).when(size >= whole["block_bytes"], whole["block_frames"]).otherwise(part).cast("bigint")


def seek_coded(frame: Column, block_frames: Column, total: Column) -> dict[str, Column]:
    """Where an exact seek lands: result, block and frame within it. A frame past the end is INVALID."""
    ok = (frame >= 0) & (frame <= total)
    return {"result": F.when(ok, "OK").otherwise("INVALID"), "block": F.when(ok, F.floor(frame / block_frames)).cast("bigint"), "skip": F.when(ok, frame % block_frames).cast("bigint")}


def track_result(rate: Column, mask: Column, channels: Column, fmt: Column) -> Column:
    """OK, or INVALID for a track without rate, with an invalid layout or an unknown sample format."""
    good = (rate > 0) & layout_valid(mask, channels) & fmt.isin(*[f[0] for f in FORMATS])
    return F.when(F.coalesce(good, F.lit(False)), "OK").otherwise("INVALID")
