"""Media column of baseline JPEG: lossless payloads in the coefficients, Huffman decoding, DC thumbnails.

A payload goes into the quantised coefficients, the format's own lossless unit: 192 bytes fill
the three 8 x 8 blocks of one MCU (4:4:4). Byte b becomes the coefficient whose category is 8
and whose extra bits are b, so no byte is zero and every category is legal. The scan
restarts after each MCU. The unpadded length stands in a comment.

The decoder takes any baseline JPEG (sampling factors, restart intervals, several scans, own tables).
Restart segments are independent, so those of a whole batch of images are Huffman-decoded in
step, one symbol of each at a time, in numpy. DC coefficients of the first component alone
give the luminance thumbnail, a pixel a block.

Defined results: null text is empty, and an empty text is one MCU of spaces; equal texts give equal
media; rows are independent; an empty table gives no rows; further columns are ignored. A stream
that is no baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

#: Bytes of an MCU; MCUs of a row or column of an image, at most.
UNIT, MOST_SIDE = 192, 8191
#: Coefficients that one decoding pass holds.
PASS_COEFFICIENTS = 2_000_000
#: Entropy-coded block without coefficients, three times, filled up with ones: an unused MCU of the grid.
FILL = b"\xaa\xaf"
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def table(kind: int, symbols: bytes) -> bytes:
    """DHT body with codes of 1, 2, ... bits for the symbols."""
    return bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + symbols


def grid(mcus: int) -> tuple[int, int]:
    """Columns and rows of the most square grid that holds so many MCUs."""
    wide = min(int(np.ceil(np.sqrt(mcus))), MOST_SIDE)
    high = -(-mcus // wide)
    if high > MOST_SIDE:
        raise ValueError("the payload is too long for one image")
    return wide, high


def head(mcus: int, n_bytes: int) -> bytes:
    wide, high = grid(mcus)
    frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), segment(0xFE, str(n_bytes).encode()), segment(0xDB, b"\0" + b"\x01" * 64),
        segment(0xC0, frame), segment(0xC4, table(0x00, b"\x08\0") + table(0x10, b"\x08\0")), segment(0xDD, (1).to_bytes(2, "big")), segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ])


def encode_payloads(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 192; lengths: unpadded."""
    counts = np.array([len(p) // UNIT for p in payloads])
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    scans: list[np.ndarray] = []
    for at in range(0, len(samples), PASS_COEFFICIENTS // UNIT):
        bits = np.zeros((len(part := samples[at : at + PASS_COEFFICIENTS // UNIT]), UNIT, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(part[:, :, None], axis=2)  # code 0, then the extra bits
        scans.append(np.packbits(bits.reshape(len(part), -1), axis=1))
    coded = np.concatenate(scans)
    out, first = [], 0
    for n, size in zip(counts.tolist(), lengths, strict=True):
        wide, high = grid(n)
        marked = np.empty((n, coded.shape[1] + 2), np.uint8)
        marked[:, :-2] = coded[first : first + n]
        marked[:, -2], marked[:, -1] = 0xFF, 0xD0 + np.arange(n) % 8
        stuffed = np.flatnonzero(marked[:, :-2] == 0xFF)
        flat = marked.ravel()
        if len(stuffed):
            width = coded.shape[1]
            flat = np.insert(flat, stuffed // width * (width + 2) + stuffed % width + 1, 0)
        scan = flat.tobytes() + b"".join(FILL + bytes([0xFF, 0xD0 + k % 8]) for k in range(n, wide * high))
        out.append(head(n, size) + scan[:-2] + b"\xff\xd9")
        first += n
    return out


@dataclass
class Scan:
    """Entropy-coded segments of one scan and how to read them."""

    components: list[int]
    tables: list[tuple[bytes, bytes]]
    restart: int
    data: np.ndarray


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: Of each component: id, horizontal and vertical sampling, quantisation table.
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    #: Of each component: blocks in raster order, coefficients in zigzag order.
    blocks: list[np.ndarray] = field(default_factory=list)

    @property
    def most(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    def block_grid(self, i: int) -> tuple[int, int]:
        """Columns and rows of a component's blocks, filled up to whole MCUs."""
        h, v = self.most
        return -(-self.width // (8 * h)) * self.components[i][1], -(-self.height // (8 * v)) * self.components[i][2]

    def own_grid(self, i: int) -> tuple[int, int]:
        """Columns and rows of the blocks that hold samples, as a scan of one component counts them."""
        h, v = self.most
        _, ch, cv, _ = self.components[i]
        return -(--(-self.width * ch // h) // 8), -(--(-self.height * cv // v) // 8)

    def thumbnail(self) -> np.ndarray:
        """Luminance from DC alone, a pixel a block."""
        wide, high = self.block_grid(0)
        dc = self.blocks[0][:, 0].astype(np.int64) * int(self.quantisation[self.components[0][3]][0])
        return np.clip(np.round(dc / 8 + 128), 0, 255).astype(np.uint8).reshape(high, wide)[: -(-self.height // 8), : -(-self.width // 8)]


def parse(data: bytes) -> Image:
    """Markers, tables and scans; the scans are not decoded yet."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at, restart = Image(), 2, 0
    huffman: dict[int, bytes] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if body[0] != 8:
                raise ValueError("baseline has 8-bit samples")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            order = {c[0]: i for i, c in enumerate(image.components)}
            chosen = [(order[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            rest = np.frombuffer(data, np.uint8, offset=at)
            marks = np.flatnonzero(rest[:-1] == 0xFF)
            after = rest[marks + 1]
            ends = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            stop = int(ends[0]) if len(ends) else len(rest)
            image.scans.append(Scan([i for i, _ in chosen], [(huffman[t >> 4], huffman[0x10 | t & 15]) for _, t in chosen], restart, rest[:stop]))
            at += stop
    if not image.components or not image.scans:
        raise ValueError("no frame or no scan")
    return image


def lookup(spec: bytes) -> np.ndarray:
    """For each 16-bit prefix: code length times 256 plus symbol; 0 where there is no code."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for symbol in spec[at : at + spec[length - 1]]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
            code += 1
        at += spec[length - 1]
        code <<= 1
    return out


def split_segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without stuffing and markers, and where each restart segment starts."""
    high = np.flatnonzero(data[:-1] == 0xFF)
    after = data[high + 1]
    restarts = high[after >= 0xD0]
    keep = np.ones(len(data), bool)
    keep[high[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    places = np.cumsum(keep) - keep
    return data[keep], np.concatenate([[0], places[restarts]])


class Reader:
    """Bit positions of many segments, read in step."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        n = len(data) + 3
        self.window = padded[:n] << 32
        for k, shift in enumerate((24, 16, 8, 0), 1):
            self.window |= padded[k : n + k] << shift
        self.bit = starts.astype(np.int64) * 8

    def symbol(self, who: np.ndarray | slice, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each, and its extra bits made into a number; positions move past both."""
        bit = self.bit[who]
        seen = (self.window[bit >> 3] << (bit & 7)) & 0xFFFFFFFFFF
        entry = codes[seen >> 24]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("no such code")
        size = symbol & 15
        extra = (seen >> (40 - length - size)) & ((1 << size) - 1)
        self.bit[who] = bit + length + size
        return symbol, extra - np.where(extra < (1 << size >> 1), (1 << size) - 1, 0)


def decode_segments(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, pattern: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Coefficients (segment, block, 64), zigzag; pattern: predictor, DC and AC codes of an MCU's blocks."""
    reader, n = Reader(data, starts), len(starts)
    most = int(mcus.max(initial=0))
    out = np.zeros((n, most * len(pattern), 64), np.int16)
    flat = out.reshape(-1)
    before = np.zeros((max(p for p, _, _ in pattern) + 1, n), np.int64)
    tables = {spec: lookup(spec) for _, dc, ac in pattern for spec in (dc, ac)}
    for mcu in range(most):
        live = np.flatnonzero(mcus > mcu)
        for b, (predictor, dc, ac) in enumerate(pattern):
            base = (live * out.shape[1] + mcu * len(pattern) + b) * 64
            _, change = reader.symbol(live, tables[dc])
            before[predictor, live] += change
            flat[base] = before[predictor, live]
            who, k = live, np.ones(len(live), np.int64)
            while len(who):
                symbol, value = reader.symbol(who, tables[ac])
                run, size = symbol >> 4, symbol & 15
                k = k + run
                held = size > 0
                if held.all():
                    flat[base + k] = value
                    k = k + 1
                    going = k < 64
                else:
                    flat[(base + k)[held]] = value[held]
                    k = k + 1
                    going = (k < 64) & (held | (run == 15))
                if not going.all():
                    who, k, base = who[going], k[going], base[going]
    return out


def decode_images(streams: list[bytes]) -> list[Image]:
    """Parsed images with their coefficients; all segments that share tables are decoded in step."""
    images = [parse(s) for s in streams]
    for image in images:
        image.blocks = [np.zeros((np.prod(image.block_grid(i)), 64), np.int16) for i in range(len(image.components))]
    jobs = defaultdict(list)
    for image in images:
        for scan in image.scans:
            if len(scan.components) == 1:
                pattern = [(0, *scan.tables[0])]
                mcus = int(np.prod(image.own_grid(scan.components[0])))
            else:
                pattern = [(p, *scan.tables[p]) for p, i in enumerate(scan.components) for _ in range(image.components[i][1] * image.components[i][2])]
                h, v = image.most
                mcus = -(-image.width // (8 * h)) * -(-image.height // (8 * v))
            data, starts = split_segments(scan.data)
            each = scan.restart or mcus
            counts = np.minimum(each, mcus - each * np.arange(-(-mcus // each)))
            if len(starts) < len(counts):
                raise ValueError("a restart segment is missing")
            jobs[tuple(pattern), each].append((image, scan, data, starts[: len(counts)], counts))
    for (pattern, each), held in jobs.items():
        room = max(1, PASS_COEFFICIENTS // (64 * len(pattern) * each))
        while held:
            some, segments = [], 0
            while held and (not some or segments + len(held[-1][3]) <= room):
                some.append(held.pop())
                segments += len(some[-1][3])
            offsets = np.cumsum([0] + [len(x[2]) for x in some])
            data = np.concatenate([x[2] for x in some])
            starts = np.concatenate([x[3] + o for x, o in zip(some, offsets, strict=False)])
            counts = np.concatenate([x[4] for x in some])
            at = 0
            coded = [decode_segments(data[s0:], starts[c : c + room] - s0, counts[c : c + room], list(pattern)) for c in range(0, len(starts), room) for s0 in [starts[c]]]
            coded = np.concatenate(coded) if len({x.shape[1] for x in coded}) == 1 else None if not coded else np.concatenate([np.pad(x, ((0, 0), (0, max(y.shape[1] for y in coded) - x.shape[1]), (0, 0))) for x in coded])
            for image, scan, _, own, own_counts in some:
                part = coded[at : at + len(own)].reshape(len(own), -1, len(pattern), 64)
                whole = part[np.arange(part.shape[1])[None, :] < own_counts[:, None]]  # (MCU, block of it, 64)
                place(image, scan, whole)
                at += len(own)
    return images


def place(image: Image, scan: Scan, mcus: np.ndarray) -> None:
    """Put the blocks of a scan's MCUs where they belong in their components."""
    order = np.arange(len(mcus))
    if len(scan.components) == 1:
        i = scan.components[0]
        image.blocks[i][order // image.own_grid(i)[0] * image.block_grid(i)[0] + order % image.own_grid(i)[0]] = mcus[:, 0]
        return
    across, b = -(-image.width // (8 * image.most[0])), 0
    for i in scan.components:
        _, h, v, _ = image.components[i]
        for y in range(v):
            for x in range(h):
                image.blocks[i][(order // across * v + y) * image.block_grid(i)[0] + order % across * h + x] = mcus[:, b]
                b += 1


def stored_payload(image: Image) -> tuple[bytes, int]:
    """The payload in an image of `encode_payloads`, and its unpadded length."""
    n_bytes = int(image.comments[0])
    units = max(1, -(-n_bytes // UNIT))
    values = np.stack([b[:units] for b in image.blocks], axis=1).astype(np.int16)
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes(), n_bytes


def cell_overlaps(n: int, cells: int) -> np.ndarray:
    """(cells, n): how much of each of n pixels lies in each of the equal cells, in 1 / cells of a pixel."""
    pixel, cell = np.arange(n) * cells, np.arange(cells)[:, None] * n
    return np.maximum(0, np.minimum(pixel + cells, cell + n) - np.maximum(pixel, cell))


def thumbnail_hashes(pixels: np.ndarray) -> str:
    """Average and difference hash of a thumbnail, 64 bits each, as hex, of the sums over 8 x 9 cells of equal area."""
    small = cell_overlaps(pixels.shape[0], 8) @ pixels.astype(np.int64) @ cell_overlaps(pixels.shape[1], 9).T
    mean = small[:, :8] * 64 >= small[:, :8].sum()
    return f"{np.packbits(mean).tobytes().hex()}:{np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, filled up with spaces, as a JPEG."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            padded = [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT) for t in texts]
            media = encode_payloads(padded, [len(t) for t in texts]) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, rows, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, media) give back: lengths, hashes, dimensions and thumbnail hashes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(1).to_pylist()
            out: list[tuple] = []
            for stream, image in zip(streams, decode_images(streams), strict=True):
                payload, n_bytes = stored_payload(image)
                feature = f"{image.width}x{image.height}:{thumbnail_hashes(image.thumbnail())}"
                out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in FEATURES.split(", ")])

    return map_batches(media.select("doc_id", "media"), rows, FEATURES)
