"""Tiled TIFF files: a numpy parser and writer, and a Spark data source of their tiles.

``spark.read.format("tiled_tiff").load(path)`` gives the tile table; options ``level``, ``x``, ``y``, ``w``, ``h`` prune
it to the tiles that a window of a level overlaps before any is read. Uncompressed, deflated, PackBits and zstd tiles are
supported; the codecs of photographs need libraries that are not here.
Files are opened by pyarrow's file systems, so that every executor can read its own tiles.
"""

from __future__ import annotations

import glob
import itertools
import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import UnsupportedSlideError
from ..model import Compression

TILE_TABLE = "slide_id string, level int, tile_row int, tile_col int, width int, height int, bands int, data binary"
#: TIFF field types (size, format), tags and compression codes.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES = 256, 257, 258, 259, 262, 277
X_RESOLUTION, Y_RESOLUTION, UNIT, SOFTWARE, COLOR_MAP = 282, 283, 296, 305, 320
TILE_WIDTH, TILE_LENGTH, OFFSETS, BYTES, SUBFILE, DESCRIPTION = 322, 323, 324, 325, 254, 270
CODES = {1: Compression.NONE, 8: Compression.DEFLATE, 32946: Compression.DEFLATE, 32773: Compression.PACKBITS, 50000: Compression.ZSTD}
#: Micrometres in a resolution unit.
UNITS = {2: 25400.0, 3: 10000.0, 4: 1000.0, 5: 1.0}


def open_file(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return system.open_input_file(inner)


@dataclass
class Page:
    """A directory of the file."""

    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def size(self) -> tuple[int, int]:
        return self.one(WIDTH), self.one(LENGTH)

    @property
    def tile(self) -> tuple[int, int]:
        if TILE_WIDTH not in self.tags:
            raise UnsupportedSlideError("the page isn't tiled")
        return self.one(TILE_WIDTH), self.one(TILE_LENGTH)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.size[0] // self.tile[0]), -(-self.size[1] // self.tile[1])

    def mpp(self) -> tuple[float, float] | None:
        unit = UNITS.get(self.one(UNIT))
        if unit is None or X_RESOLUTION not in self.tags:
            return None
        ratio = lambda tag: unit / (self.tags[tag][0] / self.tags[tag][1]) if self.tags[tag][0] else 0.0
        return ratio(X_RESOLUTION), ratio(Y_RESOLUTION)


def pack_bits(raw: bytes) -> bytes:
    """Runs of two or more bytes as (257 - n, byte), others as (n - 1, bytes)."""
    out, literal, i = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(raw):
        j = i + 1
        while j < len(raw) and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i > 1:
            flush()
            out.extend((257 - (j - i), raw[i]))
        else:
            literal.append(raw[i])
        i = j
    flush()
    return bytes(out)


def unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _zstd():
    import zstandard

    return zstandard


ENCODERS = {Compression.NONE: bytes, Compression.DEFLATE: lambda b: zlib.compress(b, 6), Compression.PACKBITS: pack_bits, Compression.ZSTD: lambda b: _zstd().ZstdCompressor().compress(b)}
DECODERS = {Compression.NONE: bytes, Compression.DEFLATE: zlib.decompress, Compression.PACKBITS: unpack_bits, Compression.ZSTD: lambda b: _zstd().ZstdDecompressor().decompress(b)}
TAG_OF = {Compression.NONE: 1, Compression.DEFLATE: 8, Compression.PACKBITS: 32773, Compression.ZSTD: 50000}


def read_pages(f) -> list[Page]:
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise UnsupportedSlideError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, entry, inline, word = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    pages = []
    while at:
        f.seek(at)
        n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
        raw = f.read(n * entry + inline)
        page = Page()
        for k in range(n):
            e = raw[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", e[:4])
            number = struct.unpack(order + word, e[4 : 4 + inline])[0]
            if kind not in TYPES:
                continue
            size, form = TYPES[kind]
            value = e[4 + inline :]
            if size * number > inline:
                f.seek(struct.unpack(order + word, value)[0])
                value = f.read(size * number)
            page.tags[tag] = (value[:number].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + form * number, value[: size * number])
        pages.append(page)
        at = struct.unpack(order + word, raw[n * entry : n * entry + inline])[0]
    return pages


def read_tile(f, page: Page, row: int, col: int) -> np.ndarray:
    """Pixels of a tile, cropped to the page; a tile without bytes is black."""
    (tw, th), (w, h), k = page.tile, page.size, row * page.grid[0] + col
    n = page.tags[BYTES][k]
    if not n:
        pixels = np.zeros((th, tw, page.bands), np.uint8)
    else:
        f.seek(page.tags[OFFSETS][k])
        raw, code = f.read(n), CODES.get(page.one(COMPRESSION, 1))
        if code is None:
            raise UnsupportedSlideError(f"unsupported compression {page.one(COMPRESSION)}")
        pixels = np.frombuffer(DECODERS[code](raw), np.uint8).reshape(th, tw, page.bands)
    return pixels[: min(th, h - row * th), : min(tw, w - col * tw)]


def overlapping(page: Page, x: int, y: int, w: int, h: int) -> list[tuple[int, int]]:
    """(row, col) of the tiles under a window; one that leaves the page is an error."""
    if x < 0 or y < 0 or w < 0 or h < 0 or x + w > page.size[0] or y + h > page.size[1]:
        raise ValueError("requested window is outside the page")
    tw, th = page.tile
    return [(r, c) for r in range(y // th, -(-(y + h) // th)) for c in range(x // tw, -(-(x + w) // tw))]


def read_window(f, page: Page, x: int, y: int, w: int, h: int) -> np.ndarray:
    out, (tw, th) = np.zeros((h, w, page.bands), np.uint8), page.tile
    for r, c in overlapping(page, x, y, w, h):
        t = read_tile(f, page, r, c)
        a, b = max(x, c * tw), max(y, r * th)
        z, q = min(x + w, c * tw + t.shape[1]), min(y + h, r * th + t.shape[0])
        out[b - y : q - y, a - x : z - x] = t[b - r * th : q - r * th, a - c * tw : z - c * tw]
    return out


def describe(path: str) -> dict:
    """Size, spacing, levels and properties of a file."""
    with open_file(path) as f:
        pages = read_pages(f)
    first = pages[0]
    mpp = first.mpp()
    w, h = first.size
    levels = []
    for k, p in enumerate(pages):
        own = p.mpp()
        down = own[0] / mpp[0] if own and mpp and mpp[0] else w / p.size[0]
        levels.append({"level": k, "width": p.size[0], "height": p.size[1], "downsample": down, "mpp_x": own[0] if own else None, "mpp_y": own[1] if own else None})
    names = {WIDTH: "width", LENGTH: "height", SAMPLES: "bands", COMPRESSION: "compression", PHOTOMETRIC: "photometric", SOFTWARE: "software", DESCRIPTION: "description", TILE_WIDTH: "tile_width", TILE_LENGTH: "tile_height"}
    return {"width": w, "height": h, "mpp": mpp, "levels": levels, "properties": {n: str(first.one(t)) for t, n in names.items() if t in first.tags}}


@dataclass
class Rows(InputPartition):
    path: str
    slide: str
    level: int
    tiles: list[tuple[int, int]]


def files_of(path: str) -> list[str]:
    """A file, the TIFF files of a folder, or those that a pattern matches, in order of their names."""
    path = path.removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/*") if p.lower().endswith((".tif", ".tiff")))
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        """Runs of tiles of a level, some 64 each."""
        out = []
        for path in files_of(self.options["path"]):
            slide = self.options.get("slide_id") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with open_file(path) as f:
                pages = read_pages(f)
            for level, page in enumerate(pages):
                if "level" in self.options and int(self.options["level"]) != level:
                    continue
                if "w" in self.options:
                    tiles = overlapping(page, *(int(self.options[k]) for k in "xywh"))
                else:
                    nx, ny = page.grid
                    tiles = [(r, c) for r in range(ny) for c in range(nx)]
                step = int(self.options.get("tiles", 64))
                out += [Rows(path, slide, level, tiles[k : k + step]) for k in range(0, len(tiles), step)]
        return out or [Rows(self.options["path"], "", 0, [])]

    def read(self, partition: Rows):
        if not partition.tiles:
            return
        with open_file(partition.path) as f:
            page = read_pages(f)[partition.level]
            for r, c in partition.tiles:
                t = read_tile(f, page, r, c)
                yield partition.slide, partition.level, r, c, t.shape[1], t.shape[0], t.shape[2], t.tobytes()


class TiledTiff(DataSource):
    """The tile table of a file, of a folder's files or of those that a pattern matches."""

    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return TILE_TABLE

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


class TiffWriter:
    """A tiled, optionally pyramidal BigTIFF, written tile by tile to a temporary name and then moved."""

    def __init__(self, path: str, size: tuple[int, int, int], mpp: tuple[float, float], tile: tuple[int, int] = (512, 512), pyramid: bool = False, colormap: dict[int, tuple[int, int, int]] | None = None, compression: str = "deflate", is_mask: bool = False, metadata: dict | None = None):
        """``size`` is width, height, bands."""
        kind = Compression(compression)
        if kind not in ENCODERS:
            raise NotImplementedError(f"no encoder for {kind.value}")
        if colormap is not None and size[2] != 1:
            raise ValueError("a colour map needs a single band")
        self.path, self.size, self.mpp, self.tile, self.pyramid = path, size, mpp, tile, pyramid
        self.colormap, self.compression, self.is_mask, self.metadata = colormap, kind, is_mask, metadata or {}

    def level_sizes(self) -> list[tuple[int, int]]:
        w, h, _ = self.size
        if not self.pyramid:
            return [(w, h)]
        n = max(0, min(int(np.ceil(np.log2(w / self.tile[0]))), int(np.ceil(np.log2(h / self.tile[1])))))
        return [(w // 2**k, h // 2**k) for k in range(n + 1)]

    def _fields(self, level: int, size: tuple[int, int], offsets: list[int], counts: list[int]) -> list[tuple]:
        bands = self.size[2]
        per_cm = [1 / m * 10000 / 2**level for m in self.mpp]
        out = [
            (SUBFILE, 4, [1 if level else 0]), (WIDTH, 4, [size[0]]), (LENGTH, 4, [size[1]]), (BITS, 3, [8] * bands),
            (COMPRESSION, 3, [TAG_OF[self.compression]]), (PHOTOMETRIC, 3, [3 if self.colormap else 2 if bands >= 3 else 1]), (SAMPLES, 3, [bands]),
            (X_RESOLUTION, 5, [round(per_cm[0] * 10_000), 10_000]), (Y_RESOLUTION, 5, [round(per_cm[1] * 10_000), 10_000]), (UNIT, 3, [3]),
            (TILE_WIDTH, 4, [self.tile[0]]), (TILE_LENGTH, 4, [self.tile[1]]), (OFFSETS, 16, offsets), (BYTES, 16, counts),
        ]
        if self.metadata and not level:
            out.append((DESCRIPTION, 2, repr(self.metadata).encode() + b"\0"))
        if self.colormap:
            out.append((COLOR_MAP, 3, [self.colormap.get(i, (0, 0, 0))[b] * 256 for b in range(3) for i in range(256)]))
        return sorted(out, key=lambda x: x[0])

    def from_tiles(self, tiles) -> None:
        """Write from an iterator of level-0 tiles in row-major order; further levels are made from the one before,
        whose tiles are read back from the file: four tiles are held at a time."""
        sizes = self.level_sizes()
        temporary = f"{self.path}.partial"
        with open(temporary, "w+b") as f:
            f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
            link, before = 8, None
            for level, (w, h) in enumerate(sizes):
                nx, ny = -(-w // self.tile[0]), -(-h // self.tile[1])
                offsets, counts = [], []
                source = iter(tiles) if level == 0 else (self._half(f, before, r, c, w, h) for r in range(ny) for c in range(nx))
                for _ in range(nx * ny):
                    t = np.asarray(next(source), np.uint8)
                    t = t.reshape(t.shape[0], t.shape[1], -1)
                    full = np.zeros((self.tile[1], self.tile[0], self.size[2]), np.uint8)
                    full[: t.shape[0], : t.shape[1]] = t
                    raw = ENCODERS[self.compression](full.tobytes())
                    f.seek(0, 2)
                    offsets.append(f.tell())
                    counts.append(len(raw))
                    f.write(raw)
                before = (offsets, counts, nx, ny)
                link = self._directory(f, link, self._fields(level, (w, h), offsets, counts))
        os.replace(temporary, self.path)

    def _half(self, f, before: tuple[list[int], list[int], int, int], row: int, col: int, w: int, h: int) -> np.ndarray:
        """A tile of the next level from the four of the one before."""
        tw, th = self.tile
        offsets, counts, nx, ny = before
        big = np.zeros((2 * th, 2 * tw, self.size[2]), np.uint8)
        for r in (2 * row, 2 * row + 1):
            for c in (2 * col, 2 * col + 1):
                if r < ny and c < nx:
                    f.seek(offsets[r * nx + c])
                    t = np.frombuffer(DECODERS[self.compression](f.read(counts[r * nx + c])), np.uint8).reshape(th, tw, -1)
                    big[(r - 2 * row) * th : (r - 2 * row + 1) * th, (c - 2 * col) * tw : (c - 2 * col + 1) * tw] = t
        made = big[::2, ::2] if self.is_mask else np.round((big[::2, ::2].astype(np.uint16) + big[1::2, ::2] + big[::2, 1::2] + big[1::2, 1::2]) / 4).astype(np.uint8)
        return made[: min(th, h - row * th), : min(tw, w - col * tw)]

    @staticmethod
    def _directory(f, link: int, fields: list[tuple]) -> int:
        entries = []
        f.seek(0, 2)
        for tag, kind, values in fields:
            raw = values if kind == 2 else struct.pack("<" + {3: "H", 4: "I", 5: "I", 16: "Q"}[kind] * len(values), *values)
            number = len(values) // 2 if kind == 5 else len(values)
            if len(raw) <= 8:
                entries.append(struct.pack("<HHQ", tag, kind, number) + raw.ljust(8, b"\0"))
            else:
                entries.append(struct.pack("<HHQQ", tag, kind, number, f.tell()))
                f.write(raw)
        at = f.tell()
        f.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
        f.seek(link)
        f.write(struct.pack("<Q", at))
        f.seek(0, 2)
        return at + 8 + 20 * len(entries)

    def from_image(self, image: np.ndarray) -> None:
        """Write from rows x columns x bands; an image smaller than a tile is an error."""
        image = image.reshape(image.shape[0], image.shape[1], -1)
        if image.shape[1] < self.tile[0] or image.shape[0] < self.tile[1]:
            raise RuntimeError("the image is smaller than a tile")
        tw, th = self.tile
        self.from_tiles(image[r : r + th, c : c + tw] for r in range(0, image.shape[0], th) for c in range(0, image.shape[1], tw))


def write_tile_table(tiles, path: str, **how) -> None:
    """A TIFF from the level-0 rows of a tile table, streamed in row-major order partition by partition."""
    level = tiles.filter("level = 0").orderBy("tile_row", "tile_col")
    rows = (np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["bands"]) for r in level.toLocalIterator())
    TiffWriter(path, **how).from_tiles(rows)


def write_slides(tiles, slides, folder: str, tile: tuple[int, int], **how):
    """(slide_id, path): a TIFF in ``folder`` (shared by the executors) for each slide of a tile table, written where
    its tiles are: one tile is held at a time. ``slides``: slide_id, width, height, bands, mpp."""
    rows = tiles.filter("level = 0").select("slide_id", "tile_row", "tile_col", "height", "width", "data")
    size = slides.selectExpr("slide_id", "width AS _w", "height AS _h", "bands AS _b", "CAST(mpp AS double) AS _m")
    dealt = rows.join(size, "slide_id").repartition("slide_id").sortWithinPartitions("slide_id", "tile_row", "tile_col")
    kind = rows.schema["slide_id"].dataType.simpleString()

    def flat(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("slide_id", "_w", "_h", "_b", "_m", "height", "width", "data")), strict=True)

    def run(batches):
        for slide, group in itertools.groupby(flat(batches), lambda r: r[0]):
            first = next(group)
            path = f"{folder}/{slide}.tiff"
            pixels = (np.frombuffer(r[7], np.uint8).reshape(r[5], r[6], r[3]) for r in itertools.chain([first], group))
            TiffWriter(path, first[1:4], (first[4], first[4]), tile, **how).from_tiles(pixels)
            yield pa.RecordBatch.from_arrays([pa.array([slide]), pa.array([path])], names=["slide_id", "path"])

    return dealt.mapInArrow(run, f"slide_id {kind}, path string")


def tile_batches(image: np.ndarray, slide_id: str, tile: tuple[int, int], level: int = 0) -> pa.Table:
    """Tile-table rows of an image."""
    image = image.reshape(image.shape[0], image.shape[1], -1)
    rows = [(slide_id, level, r // tile[1], c // tile[0], p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for r in range(0, image.shape[0], tile[1]) for c in range(0, image.shape[1], tile[0]) for p in [image[r : r + tile[1], c : c + tile[0]]]]
    names = ["slide_id", "level", "tile_row", "tile_col", "width", "height", "bands", "data"]
    kinds = [pa.string(), *[pa.int32()] * 6, pa.binary()]
    return pa.table({n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
