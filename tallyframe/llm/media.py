"""Media columns in TIFF: a reader of image directories and a writer of grey-scale pages.

``read_pages`` walks the directories of a file in either byte order, decodes strips or tiles stored raw, with PackBits,
LZW or deflate, undoes the horizontal predictor, and yields one page after another. ``pages`` runs it over a column
and emits one row per page. ``store_texts`` keeps the UTF-8 bytes of a text, padded with zeros to a multiple of 64, as
8-bit samples of pages 64 wide, so that the text comes back byte for byte; its bytes decide whether it is held in strips or
tiles, which compression and byte order it has, and whether the predictor is used.

A null text is an empty one. A null or damaged file gives one row with page null and the reason in ``fault``; pages
before the damage are kept. Repeated rows stay. Columns besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches

WIDTH = 64
PAGE_ROWS = 4096  # rows of a page that the writer makes: 256 KiB
STRIP_ROWS = 1024
TILE = (32, 256)
PAGES_HELD = 4 << 20  # bytes of samples in a batch of page rows, about
# Fixed values of the format: tags, field sizes, compression codes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


@dataclass
class Page:
    width: int
    height: int
    compression: int
    samples: np.ndarray  # height x width x samples of a pixel


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals."""
    out, i, n = bytearray(), 0, len(data)
    literal = bytearray()

    def flush():
        for a in range(0, len(literal), 128):
            part = literal[a : a + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < n:
        j = i + 1
        while j < n and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes((257 - (j - i), data[i]))
        else:
            literal.extend(data[i:j])
        i = j
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Variable-width codes from 9 to 12 bits, most significant bit first, with the early change of width."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code):
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    table = {bytes((i,)): i for i in range(256)}
    following, prefix = 258, b""
    for byte in data:
        longer = prefix + bytes((byte,))
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = following
        following += 1
        prefix = bytes((byte,))
        if following == 4094:
            put(table[prefix])
            put(256)
            table = {bytes((i,)): i for i in range(256)}
            following, width, prefix = 258, 9, b""
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    if prefix:
        put(table[prefix])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _decoded(data: bytes, compression: int, expected: int) -> bytes:
    if compression == RAW:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data)
    elif compression == LZW:
        out = lzw_decode(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        reader = zlib.decompressobj()
        out = reader.decompress(data, expected + 1) if expected else b""
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < expected:
        raise ValueError("strip or tile too short")
    return out[:expected]


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(count):
        place = at + 2 + 12 * i
        tag, kind, many = struct.unpack_from(order + "HHI", data, place)
        size = FIELD_SIZE.get(kind, 0) * many
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if kind in FIELD:
            if start + size > len(data):
                raise ValueError("field beyond the end")
            found[tag] = list(struct.unpack_from(f"{order}{many}{FIELD[kind]}", data, start))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return found, following


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories. Raises ValueError or struct.error on damage."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        fields, at = _fields(data, at, order)
        yield _page(data, fields, order)


def _page(data: bytes, fields: dict[int, list[int]], order: str) -> Page:
    def one(tag, default=None):
        value = fields.get(tag, [default])[0]
        if value is None:
            raise ValueError(f"tag {tag} is missing")
        return value

    width, height, samples = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES, 1)
    bits, compression, predictor = fields.get(BITS, [1]), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    planar = one(PLANAR, 1)
    if len(set(bits)) != 1 or bits[0] not in (1, 8, 16, 32):
        raise ValueError(f"bits {bits}")
    depth = bits[0]
    kind = np.dtype({1: "u1", 8: "u1", 16: order + "u2", 32: order + "u4"}[depth])
    if one(SAMPLE_FORMAT, 1) == 3 and depth == 32 and predictor == 1:
        kind = np.dtype(order + "f4")
    planes = samples if planar == 2 else 1
    deep = 1 if planar == 2 else samples  # samples of a pixel in a block
    if TILE_OFFSETS in fields:
        block_w, block_h = one(TILE_WIDTH), one(TILE_LENGTH)
        offsets, counts = fields[TILE_OFFSETS], fields[TILE_COUNTS]
    else:
        block_w, block_h = width, min(one(ROWS_PER_STRIP, height), height) if height else 0
        offsets, counts = fields.get(STRIP_OFFSETS, []), fields.get(STRIP_COUNTS, [])
    out = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    if not out.size:
        return Page(width, height, compression, out)
    if not block_w or not block_h:
        raise ValueError("empty blocks")
    across, down = -(-width // block_w), -(-height // block_h)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise ValueError("blocks are missing")
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        row, column = divmod(place, across)
        rows = block_h if TILE_OFFSETS in fields else min(block_h, height - row * block_h)
        line = -(-block_w * deep * depth // 8)
        if offsets[k] + counts[k] > len(data):
            raise ValueError("block beyond the end")
        raw = _decoded(data[offsets[k] : offsets[k] + counts[k]], compression, line * rows)
        if depth == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : block_w * deep]
        else:
            block = np.frombuffer(raw, kind).reshape(rows, block_w * deep)
        block = block.reshape(rows, block_w, deep)
        if predictor == 2 and depth > 1:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        top, left = row * block_h, column * block_w
        part = out[top : top + rows, left : left + block_w, plane : plane + deep] if planar == 2 else out[top : top + rows, left : left + block_w]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return Page(width, height, compression, out)


def write_pages(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, compression: int = DEFLATE, predictor: int = 1, order: str = "<", tile: tuple[int, int] | None = None) -> bytes:
    """Bytes, a multiple of ``width``, as 8-bit grey pages in strips, or in tiles of (width, rows), multiples of 16.

    The same bytes always give the same file. Tiles beyond the page's edge are filled with zeros.
    """
    rows = len(payload) // width
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4  # where the place of the next directory is written
    for top in range(0, rows, page_rows):
        height = min(page_rows, rows - top)
        page = np.frombuffer(payload, np.uint8, height * width, top * width).reshape(height, width)
        if tile is None:
            blocks = [page[a : a + strip_rows] for a in range(0, height, strip_rows)]
        else:
            wide, high = tile
            padded = np.pad(page, ((0, -height % high), (0, -width % wide)))
            blocks = [padded[a : a + high, c : c + wide] for a in range(0, height, high) for c in range(0, width, wide)]
        offsets, counts = [], []
        for block in blocks:
            data = (np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8)) if predictor == 2 else block).astype(np.uint8).tobytes()
            if compression == DEFLATE:
                data = zlib.compress(data, 1)
            elif compression == PACKBITS:
                data = pack_bits(data)
            elif compression == LZW:
                data = lzw_encode(data)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        lists = len(out)
        many = len(offsets)
        if many > 1:
            out += struct.pack(f"{order}{many}I", *offsets) + struct.pack(f"{order}{many}I", *counts)
        places, sizes = (lists, lists + 4 * many) if many > 1 else (offsets[0], counts[0])
        entries = [
            (IMAGE_WIDTH, 4, 1, width), (IMAGE_LENGTH, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression),
            (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor),
        ]
        if tile is None:
            entries += [(STRIP_OFFSETS, 4, many, places), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_COUNTS, 4, many, sizes)]
        else:
            entries += [(TILE_WIDTH, 4, 1, tile[0]), (TILE_LENGTH, 4, 1, tile[1]), (TILE_OFFSETS, 4, many, places), (TILE_COUNTS, 4, many, sizes)]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries))
        for tag, kind, count, value in sorted(entries):
            out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def form_of(payload: bytes) -> dict:
    """How a text is stored, by its bytes alone: compression, predictor, byte order, strips or tiles.

    Deflate holds most texts; one in sixteen each has LZW and PackBits, which are slower here. Half have the predictor,
    a quarter tiles, half the other byte order.
    """
    mark = zlib.crc32(payload, 1)
    return {
        "compression": (LZW, PACKBITS)[mark % 16] if mark % 16 < 2 else DEFLATE,
        "predictor": 1 + (mark >> 4) % 2,
        "tile": TILE if (mark >> 5) % 4 == 0 else None,
        "order": "<>"[(mark >> 7) % 2],
    }


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as the samples of one file, in the form that ``form_of`` gives it."""

    def stored(raw):
        payload = raw + b"\0" * ((-len(raw)) % WIDTH if raw else WIDTH)
        return write_pages(payload, **form_of(payload))

    def make():
        def work(batch):
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < batch.num_rows:  # a few texts at a time, so that memory is that of the longest text
                part = texts.slice(start, 512).to_pylist()
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part]
                media = [stored(r) for r in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                start += len(part)

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(F.col(id_column), F.col(text_column)), make, f"doc_id {kind}, n_bytes bigint, media binary")


def pages(files: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per page: id (of any type), page (from 0), width, height, compression, samples as bytes, fault.

    The pages of a file follow one another in the task that read it, page 0 first.
    """
    names = ["id", "page", "width", "height", "compression", "samples", "fault"]

    def make():
        def work(batch):
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            rows, held = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for n, page in enumerate(read_pages(data.as_py() or b"")):
                        rows.append((key, n, page.width, page.height, page.compression, page.samples.tobytes(), None))
                        held += page.samples.nbytes
                        if len(rows) >= 512 or held >= PAGES_HELD:
                            yield out()
                            rows, held = [], 0
                except (ValueError, struct.error, zlib.error) as error:
                    rows.append((key, None, None, None, None, None, str(error)))
            if rows:
                yield out()

        return work

    kind = files.schema[id_column].dataType.simpleString()
    return map_batches(files.select(F.col(id_column), F.col(media_column)), make, f"id {kind}, page int, width int, height int, compression int, samples binary, fault string")


@dataclass
class Digest:
    """What the pages of one file add up to, page after page."""

    key: dict

    def __post_init__(self):
        self.sha, self.total, self.tail, self.pages = hashlib.sha256(), 0, b"", 0
        self.levels = np.zeros(256, dtype=np.int64)

    def add(self, samples: bytes) -> None:
        self.sha.update(samples)
        self.total += len(samples)
        self.tail = (self.tail + samples[-WIDTH:])[-WIDTH:]
        self.levels += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        self.pages += 1

    def row(self) -> tuple:
        k = self.key
        return (k["doc_id"], k["n_bytes"], self.total, self.sha.hexdigest(), zlib.crc32(self.tail), k["media_bytes"], k["media_sha256"], feature(self.levels), self.pages)


def digests(files: DataFrame) -> DataFrame:
    """What the stored files of ``store_texts`` hold: digests of the samples read back and of the file, features.

    The files are read through ``pages``; a file's page rows arrive one after the other and are added up as they come,
    so a task holds one page at a time and nothing is shuffled. A damaged file raises.
    """
    key = F.struct("doc_id", "n_bytes", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    rows = pages(files.select(key.alias("file"), "media"), "file", "media").select("id", "page", "samples", "fault")
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]

    def run(batches):
        one, done, kind = None, [], pa.int64()

        def out():
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], columns)

        for batch in batches:
            kind = batch.schema.field(0).type.field("doc_id").type
            for file, page, samples, fault in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if fault is not None:
                    raise ValueError(f"stored file of {file.as_py()['doc_id']}: {fault}")
                if page == 0:
                    if one is not None:
                        done.append(one.row())
                    one = Digest(file.as_py())
                one.add(samples.as_py())
                if len(done) >= 1024:
                    yield out()
                    done = []
        if one is not None:
            done.append(one.row())
        if done:
            yield out()

    kind = files.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int")


def feature(levels: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the share of each eighth of the grey scale."""
    total = max(int(levels.sum()), 1)
    scale = np.arange(256)
    mean = float((levels * scale).sum()) / total
    spread = float((levels * scale * scale).sum()) / total - mean * mean
    share = levels[levels > 0] / total
    eighths = levels.reshape(8, 32).sum(axis=1) * 1000 // total
    return f"{mean:.3f} {max(spread, 0) ** 0.5:.3f} {float(-(share * np.log2(share)).sum()) + 0:.4f} " + "-".join(map(str, eighths.tolist()))
