"""Files as rows, and what lies in them as rows: chunks, blocks, pages, packets, frames.

A file is a row (path, length, content). Each ``*_rows`` function walks the bytes of each file once, in the task that holds
it, and gives a row for each element found, with the other columns of its file; what the elements' fields mean is said in
Columns elsewhere. Null contents have no elements, and neither have bytes that are not of the format."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lookups import MPEG_BITRATES, MPEG_RATES
from .byte_ranges import FileBytes, read_ranges

#: Chunks of samples, of which only the first bytes are carried along; their places tell where the samples are.
SAMPLE_CHUNKS = (b"data", b"SSND")
HEAD = 16
#: About how many bytes of found elements go on together.
MOST_BYTES = 4_000_000


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files that a path or pattern names. A path that doesn't exist is an error."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def walked(files: DataFrame, fields: str, walk: Callable[[bytes], Iterator[tuple]], content: str | None = "content") -> DataFrame:
    """A row for each tuple that walk finds in a file's bytes, with the file's other columns. content: the column of the
    bytes; None: files are (path, length), and are read through a window."""
    kept = [c for c in files.columns if c != content]
    empty = files.sparkSession.createDataFrame([], fields)
    schema = files.select(*[F.col(f"`{c}`") for c in kept]).schema
    for f in empty.schema.fields:
        schema = schema.add(f)
    kinds = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            size = 0

            def rows() -> pa.RecordBatch:
                own = batch.take(pa.array(at, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], *[pa.array(v, f.type) for v, f in zip(zip(*found), kinds)]], [*kept, *kinds.names])  # noqa: B023

            contents = batch.column("__content") if content else zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())
            batch = batch.select(kept)
            for i, data in enumerate(contents):
                data = data.as_py() if content else FileBytes(*data)
                for row in walk(data) if data is not None else ():
                    at.append(i)
                    found.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > MOST_BYTES:
                        yield rows()
                        at, found, size = [], [], 0
                if not content:
                    data.close()
            if found:
                yield rows()

    own = [F.col(content).cast("binary").alias("__content")] if content else []
    return files.select(*[F.col(f"`{c}`") for c in kept], *own).mapInArrow(run, schema)


def each(df: DataFrame, needs: list[str], fields: str, step: Callable[..., Iterable[tuple]]) -> DataFrame:
    """df with the fields of each row that step gives for the values of needs; step gives many or none."""
    kept = df.columns
    new = df.sparkSession.createDataFrame([], fields).schema
    schema = StructType([*df.schema.fields, *new.fields])
    kinds = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, size = [], [], 0
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in needs))):
                for row in step(*values):
                    at.append(i)
                    found.append(row)
                    size += sum(len(v) for v in row if hasattr(v, "__len__"))
                if found and (size > 500_000 or i + 1 == batch.num_rows):
                    own = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(v, f.type) for v, f in zip(zip(*found), kinds)]], [*kept, *kinds.names])
                    at, found, size = [], [], 0

    return df.mapInArrow(run, schema)


def with_head(files: DataFrame, keys: list[str], content: str | None = "content", n: int = 12) -> DataFrame:
    """The keys of files with __n, a file's length, __head, its first n bytes, and what walked() reads it by: content, or
    path and length, of which only n bytes are read."""
    if content:
        c = F.col(f"`{content}`")
        return files.select(*[F.col(f"`{k}`") for k in keys], F.length(c).cast("bigint").alias("__n"), F.substring(c, 1, n).alias("__head"), c.alias("content"))
    own = files.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*keys, "path", "length"])], F.lit(0).alias("__from"), F.lit(n).alias("__to"))
    return read_ranges(own, start="__from", stop="__to", data="__head").withColumn("__n", F.col("length")).drop("__from", "__to")


def chunk_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(at, id, offset, size, data): the chunks of a RIFF or IFF file in order, from byte 12. offset is where a chunk's
    bytes start and size what its header states; both pad to even. Fewer than eight bytes at the end are ignored. What
    lies behind the data of a long form is found by the size in its ds64 chunk."""

    def walk(b: bytes):
        order = "big" if b[:4] == b"FORM" else "little"
        at, n, long = 12, 0, None
        while at + 8 <= len(b):
            size = int.from_bytes(b[at + 4 : at + 8], order)
            own = HEAD if b[at : at + 4] in SAMPLE_CHUNKS else size
            data = b[at + 8 : at + 8 + own]
            yield n, b[at : at + 4].decode("latin-1"), at + 8, size, data
            if b[at : at + 4] == b"ds64" and len(data) >= 16:
                long = int.from_bytes(data[8:16], "little")
            if b[at : at + 4] == b"data" and size == 0xFFFFFFFF and long is not None and b[:4] != b"RIFF":
                size = long
            at, n = at + 8 + size + (size & 1), n + 1

    return walked(files, "at int, id string, offset bigint, size bigint, data binary", walk, content)


def flac_block_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(at, type, last, offset, size, data): the metadata blocks of a FLAC file, up to the one marked last."""

    def walk(b: bytes):
        at, n = 4, 0
        while b[:4] == b"fLaC" and at + 4 <= len(b):
            size = int.from_bytes(b[at + 1 : at + 4], "big")
            yield n, b[at] & 127, b[at] >= 128, at + 4, size, b[at + 4 : at + 4 + size]
            if b[at] >= 128:
                return
            at, n = at + 4 + size, n + 1

    return walked(files, "at int, type int, last boolean, offset bigint, size bigint, data binary", walk, content)


def seek_point_rows(blocks: DataFrame, content: str = "data") -> DataFrame:
    """(sample, offset, frames): the points of SEEKTABLE blocks but for placeholders. A table of broken points has none, and
    neither has one that doesn't ascend."""

    def walk(b: bytes):
        points = [p for p in struct.iter_unpack(">qqH", b) if p[0] != -1] if len(b) % 18 == 0 else []
        if all(p[0] < q[0] for p, q in zip(points, points[1:])):
            yield from points

    return walked(blocks, "sample bigint, offset bigint, frames bigint", walk, content)


TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7 from 0, most significant bit first: the common CRC with all bits turned around."""
    c = zlib.crc32(data.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def ogg_pages(b: bytes):
    """(offset, next, serial, number, granule, flags, lacing, body) of the pages whose checksum is right, in order; what
    lies between them is passed over."""
    at = 0
    while (at := b.find(b"OggS", at)) >= 0:
        head = b[at : at + 27]
        lacing = b[at + 27 : at + 27 + (head[26] if len(head) == 27 else 0)]
        body = at + 27 + len(lacing)
        end = body + sum(lacing)
        if len(head) == 27 and head[4] == 0 and len(lacing) == head[26] and end <= len(b):
            if ogg_crc(b[at : at + 22] + bytes(4) + b[at + 26 : end]) == int.from_bytes(head[22:26], "little"):
                yield at, end, int.from_bytes(head[14:18], "little"), int.from_bytes(head[18:22], "little"), int.from_bytes(head[6:14], "little", signed=True), head[5], lacing, b[body:end]
                at = end
                continue
        at += 1


def ogg_page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    """A page's bytes with its checksum."""
    head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    rest = bytes([len(lacing)]) + lacing + body
    return head + ogg_crc(head + bytes(4) + rest).to_bytes(4, "little") + rest


def ogg_stream(serial: int, packets: list[tuple[bytes, int]]) -> bytes:
    """A logical stream of (packet, granule): each packet starts a page and goes over as many as it needs."""
    out, number = [], 0
    for i, (packet, granule) in enumerate(packets):
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for k in range(0, len(lacing), 255):
            own, ends = lacing[k : k + 255], k + 255 >= len(lacing)
            flags = (1 if k else 0) | (2 if number == 0 else 0) | (4 if ends and i + 1 == len(packets) else 0)
            out.append(ogg_page(serial, number, granule if ends else -1, flags, own, packet[k * 255 : k * 255 + sum(own)]))
            number += 1
    return b"".join(out)


def ogg_page_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(offset, next_offset, serial, number, granule, flags, segments, bytes): the pages with a right checksum."""

    def walk(b: bytes):
        for at, end, serial, number, granule, flags, lacing, body in ogg_pages(b):
            yield at, end, serial, number, granule, flags, len(lacing), len(body)

    return walked(files, "offset bigint, next_offset bigint, serial bigint, number bigint, granule bigint, flags int, segments int, bytes bigint", walk, content)


def ogg_packets(b: bytes, head: int | None = None):
    """(serial, packet, granule, data) of a file, as ogg_packet_rows() says it."""
    return packets_of(ogg_pages(b), head)


def packets_of(pages: Iterable[tuple], head: int | None = None):
    """The packets of ogg_pages(). Nothing is put together of those behind head."""
    parts: dict[int, list[bytes]] = {}
    count: dict[int, int] = {}
    for _, _, serial, _, granule, flags, lacing, body in pages:
        if head is not None and count.get(serial, 0) >= head:
            continue
        open_ = parts.get(serial)
        skip = bool(flags & 1) and open_ is None
        own = open_ if flags & 1 and open_ is not None else []
        ends = [k for k, v in enumerate(lacing) if v < 255]
        at = done = 0
        for k in ends:
            size = sum(lacing[done : k + 1])
            own.append(body[at : at + size])
            at, done = at + size, k + 1
            if not skip:
                n = count.get(serial, 0)
                count[serial] = n + 1
                if head is None or n < head:
                    yield serial, n, granule if k == ends[-1] else -1, b"".join(own)
            own, skip = [], False
        own.append(body[at:])
        if lacing and lacing[-1] == 255 and not skip:
            parts[serial] = own
        else:
            parts.pop(serial, None)


def ogg_packet_rows(files: DataFrame, content: str | None = "content", head: int | None = None) -> DataFrame:
    """(serial, packet, granule, data): the packets of each logical stream, numbered from 0, put together over pages. The
    granule is that of the page where a packet ends, if it is the last that ends there, else -1. A continued piece whose
    start is missing is dropped. head: carry no more packets of a stream than this."""
    return walked(files, "serial bigint, packet bigint, granule bigint, data binary", partial(ogg_packets, head=head), content)


def ogg_stream_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(serial, first, second, third, at, granule): a row for each logical stream with a packet: its first packet, eight
    bytes of the next two, and the last stated granule with its page's place. One walk of the file."""

    def walk(b: bytes):
        heads: dict[int, list] = {}
        last: dict[int, tuple[int, int]] = {}

        def pages():
            for page in ogg_pages(b):
                if page[4] != -1:
                    last[page[2]] = page[0], page[4]
                yield page

        for serial, n, _, data in packets_of(pages(), head=3):
            heads.setdefault(serial, [None] * 3)[n] = data[:8] if n else data
        for serial, own in heads.items():
            yield serial, *own, *last.get(serial, (None, None))

    return walked(files, "serial bigint, first binary, second binary, third binary, at bigint, granule bigint", walk, content)


# MPEG frames


def mpeg_frame(b: bytes, at: int) -> tuple | None:
    """(size, samples, rate, bitrate, kind) of a frame header, or None; kind is what all frames of a stream share."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] < 0xE0:
        return None
    v, layer, index, rate_index = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if v == 1 or layer == 4 or index == 15 or rate_index == 3:
        return None
    version, mono = {3: 1, 2: 2, 0: 25}[v], b[at + 3] >> 6 == 3
    bitrate = MPEG_BITRATES[1 if version == 1 else 2, layer][index] * 1000
    rate, pad = MPEG_RATES[version][rate_index], b[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = 0 if not bitrate else (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else 9 if mono else 17
    if size > 2880 or 0 < size < 4 + 2 * (not b[at + 1] & 1) + side:
        return None
    return size, samples, rate, bitrate, (version, layer, rate_index, mono)


def id3v2_span(b: bytes) -> int:
    """Bytes of an ID3v2 tag at the start, its footer included; 0 if there is none."""
    if b[:3] != b"ID3" or len(b) < 10 or max(b[6:10]) > 127:
        return 0
    return 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]) + (10 if b[5] & 0x10 else 0)


def first_frame(b: bytes, start: int, search: int = 65_536, wanted: int = 2) -> tuple[int, int] | None:
    """(offset, following frames found) of the first frame within search bytes of start that ``wanted`` frames of its
    kind follow where the lengths say. At the start itself, frames that the file's end cuts off need not follow, and the
    free format counts."""
    at, end = start, min(len(b), start + search)
    while (at := b.find(b"\xff", at, end)) >= 0:
        f = mpeg_frame(b, at)
        if f and (f[0] or at == start):
            if not f[0]:
                return at, 0
            n, place, size, broken = 0, at, f[0], False
            while n < wanted and place + size + 4 <= len(b):
                g = mpeg_frame(b, place + size)
                if not g or g[4] != f[4] or not g[0]:
                    broken = True
                    break
                n, place, size = n + 1, place + size, g[0]
            if not broken and (n >= wanted or at == start):
                return at, n
        at += 1
    return None


def mpeg_confidence(b: bytes | None) -> int:
    """How sure it is that the bytes are an MPEG stream: 100 from the start on, 75 further on or in the free format, 25
    where too few frames follow, 0 without a frame."""
    span = id3v2_span(b) if b else 0
    found = first_frame(b, span) if b else None
    if not found:
        return 0
    if not mpeg_frame(b, found[0])[0]:
        return 75
    return 25 if found[1] < 2 else 100 if found[0] == span else 75


def mpeg_frame_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(frame, offset, size, samples, rate, bitrate, data, sound_end): the frames of an MPEG file one behind the other,
    from the first one on; data of the first frame alone, for its tag. The walk ends where no frame of its kind follows.
    sound_end: the file's end, or where its ID3v1 trailer starts."""

    return walked(files, "frame bigint, offset bigint, size bigint, samples bigint, rate bigint, bitrate bigint, data binary, sound_end bigint", mpeg_frames, content)


def mpeg_frames(b: bytes):
    """The rows of mpeg_frame_rows() of a file."""
    end = len(b) - (128 if len(b) >= 128 and b[len(b) - 128 : len(b) - 125] == b"TAG" else 0)
    found = first_frame(b, id3v2_span(b))
    at, n = (found[0], 0) if found else (len(b), 0)
    kind = mpeg_frame(b, at)
    while (f := mpeg_frame(b, at)) and f[0] and f[4] == kind[4] and at + f[0] <= len(b):
        yield n, at, f[0], f[1], f[2], f[3], b[at : at + f[0]] if n == 0 else b[at : at + 4], end
        at, n = at + f[0], n + 1


def mpeg_track_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(data, offset, samples, walked, total, sound_end): a row for each MPEG file with a frame: the first frame and its
    place and samples, how many frames follow each other from there, and the samples of them all."""

    def walk(b: bytes):
        first, walked_, total = None, 0, 0
        for frame in mpeg_frames(b):
            first, walked_, total = first or frame, walked_ + 1, total + frame[3]
        if first:
            yield first[6], first[1], first[3], walked_, total, first[7]

    return walked(files, "data binary, offset bigint, samples bigint, walked bigint, total bigint, sound_end bigint", walk, content)


# Tags


def decoded(encoding: int, data: bytes) -> str | None:
    """Text of an ID3 encoding; broken UTF-8 is read a byte a character, and an unknown encoding is None."""
    if encoding == 1:
        order = "utf-16-be" if data[:2] == b"\xfe\xff" else "utf-16-le"
        return (data[2:] if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data)[: len(data) // 2 * 2].decode(order, "replace")
    if encoding == 2:
        return data[: len(data) // 2 * 2].decode("utf-16-be", "replace")
    if encoding == 3:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("latin-1")
    return data.decode("latin-1") if encoding == 0 else None


def split_text(encoding: int, data: bytes) -> tuple[bytes, bytes]:
    """What stands before and behind the first terminator: one NUL, or two at an even place."""
    if encoding in (1, 2):
        at = next((k for k in range(0, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), len(data))
        return data[:at], data[at + 2 :]
    at = data.find(b"\0")
    return (data, b"") if at < 0 else (data[:at], data[at + 1 :])


def id3_frame_rows(files: DataFrame, content: str | None = "content") -> DataFrame:
    """(at, id, description, value, mime, kind, data): the frames of an ID3v2.2, 2.3 or 2.4 tag at the start of the bytes.
    A text frame gives a row for each of its values; COMM, USLT and TXXX carry their description; APIC its type, kind and
    picture. Compressed or encrypted frames, and those of other ids, are carried as they are (data, no value)."""

    def walk(b: bytes):
        if not id3v2_span(b):
            return
        version, flags, end = b[3], b[5], 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9])
        tag = b[10:end]
        if flags & 0x80 and version < 4:
            tag = tag.replace(b"\xff\0", b"\xff")
        safe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
        at = 0
        if flags & 0x40 and version > 2 and len(tag) >= 4:
            at = safe(tag[:4]) if version == 4 else 4 + int.from_bytes(tag[:4], "big")
        width, head, n = (3, 6, 0) if version == 2 else (4, 10, 0)
        while at + head <= len(tag):
            name = tag[at : at + width]
            if not all(65 <= c <= 90 or 48 <= c <= 57 for c in name):
                return
            size = int.from_bytes(tag[at + 3 : at + 6], "big") if version == 2 else safe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
            own = tag[at + 8 : at + 10] if version > 2 else b"\0\0"
            data = tag[at + head : at + head + size]
            if len(data) < size:
                return
            at += head + size
            packed = own[1] & (0x0C if version == 4 else 0xC0)
            if version == 4 and not packed:
                data = data.replace(b"\xff\0", b"\xff") if own[1] & 2 or flags & 0x80 else data
                data = data[4:] if own[1] & 1 else data
            for row in frame_values(name.decode(), data) if not packed else [(None, None, None, None, data)]:
                yield n, name.decode(), *row
                n += 1

    return walked(files, "at int, id string, description string, value string, mime string, kind int, data binary", walk, content)


def frame_values(name: str, data: bytes):
    """(description, value, mime, kind, data) of each value of a frame."""
    encoding = data[0] if data else 0
    if name in ("APIC", "PIC") and len(data) > 5:
        mime, rest = (data[1:4], data[4:]) if name == "PIC" else split_text(0, data[1:])
        description, picture = split_text(encoding, rest[1:])
        yield decoded(encoding, description), None, mime.decode("latin-1"), rest[0] if rest else None, picture
    elif name in ("COMM", "COM", "USLT", "ULT", "TXXX", "TXX") and len(data) > (4 if name[0] != "T" else 1):
        description, text = split_text(encoding, data[1 if name[0] == "T" else 4 :])
        yield decoded(encoding, description), decoded(encoding, split_text(encoding, text)[0]), None, None, None
    elif name[0] == "T" and data:
        rest = data[1:]
        while rest:
            value, rest = split_text(encoding, rest)
            if value:
                yield None, decoded(encoding, value), None, None, None
    else:
        yield None, None, None, None, data


def vorbis_comment_rows(blocks: DataFrame, content: str = "data") -> DataFrame:
    """(at, key, value): the comments of a Vorbis comment block in order. One without "=", or past the end, ends or skips
    nothing else; a broken length ends the list."""

    def walk(b: bytes):
        at = 4 + int.from_bytes(b[:4], "little")
        n = int.from_bytes(b[at : at + 4], "little") if at + 4 <= len(b) else 0
        at += 4
        for k in range(n):
            size = int.from_bytes(b[at : at + 4], "little")
            own = b[at + 4 : at + 4 + size]
            if at + 4 > len(b) or len(own) < size:
                return
            at += 4 + size
            key, eq, value = own.partition(b"=")
            if eq and key:
                yield k, key.decode("latin-1"), decoded(3, value)

    return walked(blocks, "at int, key string, value string", walk, content)


def riff_info_rows(blocks: DataFrame, content: str = "data") -> DataFrame:
    """(at, key, value): the entries of a LIST chunk of type INFO, texts up to their first NUL; an entry longer than what
    is left ends the list, and empty ones are left out."""

    def walk(b: bytes):
        at, n = 4, 0
        while b[:4] == b"INFO" and at + 8 <= len(b):
            size = int.from_bytes(b[at + 4 : at + 8], "little")
            if at + 8 + size > len(b):
                return
            value = decoded(3, b[at + 8 : at + 8 + size].split(b"\0")[0])
            if value:
                yield n, b[at : at + 4].decode("latin-1"), value
            at, n = at + 8 + size + (size & 1), n + 1

    return walked(blocks, "at int, key string, value string", walk, content)


def opus_frame_rows(packets: DataFrame, content: str = "data") -> DataFrame:
    """(frame, offset, size): the frames of each Opus packet by its framing code. A packet that breaks the framing, with
    a frame above 1,275 bytes or with more than 120 ms has none."""

    def length(b: bytes, at: int) -> tuple[int, int]:
        if b[at] < 252:
            return b[at], at + 1
        return b[at] + 4 * b[at + 1], at + 2

    def split(b: bytes) -> list[tuple[int, int]] | None:
        code, at, end = b[0] & 3, 1, len(b)
        if code == 0:
            sizes = [end - 1]
        elif code == 1:
            sizes = [(end - 1) // 2] * 2 if end % 2 else None
        elif code == 2:
            first, at = length(b, 1)
            sizes = [first, end - at - first]
        else:
            n, at = b[1] & 63, 2
            ticks = (480, 960, 1920, 2880)[b[0] >> 3 & 3] if b[0] >> 3 < 12 else (480, 960)[b[0] >> 3 & 1] if b[0] >> 3 < 16 else (120, 240, 480, 960)[b[0] >> 3 & 3]
            if not n or n * ticks > 5760:
                return None
            if b[1] & 64:
                while True:
                    pad, at = b[at], at + 1
                    end -= 254 if pad == 255 else pad
                    if pad < 255:
                        break
            if b[1] & 128:
                sizes = []
                for _ in range(n - 1):
                    size, at = length(b, at)
                    sizes.append(size)
                sizes.append(end - at - sum(sizes))
            else:
                sizes = [(end - at) // n] * n if end >= at and (end - at) % n == 0 else None
        if sizes is None or min(sizes) < 0 or max(sizes) > 1275:
            return None
        return [(at + sum(sizes[:k]), s) for k, s in enumerate(sizes)]

    def walk(b: bytes):
        try:
            found = split(b) if b else None
        except IndexError:  # the packet ends within its own framing
            found = None
        for k, (at, size) in enumerate(found or []):
            yield k, at, size

    return walked(packets, "frame int, offset bigint, size bigint", walk, content)
