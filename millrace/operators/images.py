"""Image sets: a row for each file, headers and pixels as columns, resized and written in parallel.

Files are listed and read by Spark's readers. PNG (all depths, as 8 bits; interlaced
or not; without transparency of palettes), and binary PPM and PGM are decoded here
with zlib and numpy; JPEG, GIF, BMP and TIFF go through Spark's image reader (the
Java runtime's decoders). A format that neither reads, such as WebP, is unsupported, which is not
the same as corrupted: detect() counts it apart, and clean() raises instead of
dropping it. Nothing is ever stacked on the driver unless asked for.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.balance import split_rows
from millrace.plans.stats import fuse

SUFFIXES = ("png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp", "ppm", "pgm")
OTHER_SUFFIXES = ("jpg", "jpeg", "bmp", "gif", "tiff", "webp")
OTHER = r"\.(" + "|".join(OTHER_SUFFIXES) + ")$"
#: First bytes of formats that no decoder here reads.
UNSUPPORTED = ((b"RIFF", 8, b"WEBP"),)
# First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MODES = {1: "L", 3: "RGB", 4: "RGBA"}
CHANNELS = {"grayscale": 1, "L": 1, "rgb": 3, "RGB": 3, "rgba": 4, "RGBA": 4}
SMALL_FILE = 1024


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of uint8 pixels (height, width, channels)."""
    h, w, c = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.zeros((h, 1 + w * c), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(h, w * c)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Undo the five line filters of PNG."""
    rows = np.frombuffer(raw, dtype=np.uint8)[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int64)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step])
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(stride):
                left = line[x - step] & 255 if x >= step else 0
                if kind == 3:
                    line[x] += (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    guess = left + above[x] - corner
                    d = (abs(guess - left), abs(guess - above[x]), abs(guess - corner))
                    line[x] += left if d[0] <= d[1] and d[0] <= d[2] else above[x] if d[1] <= d[2] else corner
        above = line & 255
        out[y] = above
    return out


def _samples(lines: np.ndarray, count: int, depth: int, scaled: bool) -> np.ndarray:
    """The first `count` samples of each line as 8 bits; deeper ones lose their low byte, flatter ones are spread to 0..255."""
    if depth >= 8:
        return lines[:, :: depth // 8][:, :count]
    bits = np.unpackbits(lines, axis=1)[:, : count * depth].reshape(len(lines), count, depth)
    values = bits @ (1 << np.arange(depth - 1, -1, -1))
    return (values * (255 // ((1 << depth) - 1)) if scaled else values).astype(np.uint8)


def decode(data: bytes) -> np.ndarray | None:
    """uint8 pixels (height, width, channels), or None if the file cannot be read here."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, palette = 8, b"", None
            while at < len(data):
                n, name = struct.unpack(">I4s", data[at : at + 8])
                part = data[at + 8 : at + 8 + n]
                if name == b"IHDR":
                    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
                elif name == b"PLTE":
                    palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
                elif name == b"IDAT":
                    body += part
                at += 12 + n
            c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
            raw, pixels = zlib.decompress(body), np.zeros((h, w, c), dtype=np.uint8)
            for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
                wide, high = -(-(w - x) // dx), -(-(h - y) // dy)
                if wide > 0 and high > 0:
                    stride = -(-wide * c * depth // 8)
                    lines = _unfilter(raw, high, stride, max(1, c * depth // 8))
                    raw = raw[high * (stride + 1) :]
                    pixels[y::dy, x::dx] = _samples(lines, wide * c, depth, kind != 3).reshape(high, wide, c)
            return palette[pixels[:, :, 0]] if kind == 3 else pixels
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                stop = at
                while not data[stop : stop + 1].isspace():
                    stop += 1
                head.append(int(data[at:stop]))
                at = stop
            w, h, _ = head
            c = 1 if data[:2] == b"P5" else 3
            return np.frombuffer(data, dtype=np.uint8, count=w * h * c, offset=at + 1).reshape(h, w, c)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, UnboundLocalError):
        return None
    return None


def decoded(content: bytes, origin: str | None, height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray | None:
    """Pixels of a file: decoded here, or what Spark's image reader made of it (rows of blue, green, red, alpha)."""
    pixels = decode(content)
    if pixels is None and data is not None and height and width and height > 0:
        pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        pixels = pixels[:, :, [2, 1, 0, *range(3, channels)]] if channels >= 3 else pixels
    return pixels


def unsupported(content: bytes) -> bool:
    return any(content.startswith(x) and content[at : at + len(y)] == y for x, at, y in UNSUPPORTED)


def _weights(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Lanczos weights of every old position for every new one; wider when shrinking."""
    scale = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = pixels.shape[:2]
    if (h, w) == (height, width):
        return pixels
    down = np.tensordot(_weights(h, height), pixels.astype(np.float64), axes=(1, 0))
    both = np.tensordot(_weights(w, width), down, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def to_channels(pixels: np.ndarray, channels: int) -> np.ndarray:
    c = pixels.shape[2]
    if c == channels:
        return pixels
    base = pixels[:, :, :3] if c >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
    if channels == 1:
        return np.rint(base @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)[:, :, None]
    return base if channels == 3 else np.concatenate([base, np.full((*base.shape[:2], 1), 255, np.uint8)], axis=2)


class ImagePrep:
    """target_size is (height, width) everywhere."""

    def __init__(self, spark: SparkSession, image_dir: str | None = None, image_paths: list[str] | None = None, target_size: tuple[int, int] = (224, 224), color_mode: str = "rgb", normalize: bool = True) -> None:
        if color_mode not in CHANNELS:
            raise ValueError(f"Unknown color mode: {color_mode}")
        if not image_dir and not image_paths:
            raise ValueError("image_dir or image_paths is needed")
        self.spark, self.size, self.channels, self.normalize = spark, target_size, CHANNELS[color_mode], normalize
        def load(kind: str, paths: list[str] | None, suffixes: tuple[str, ...]) -> DataFrame:
            reader = spark.read.format(kind)
            if paths:
                return reader.load([*dict.fromkeys(paths)])
            both = ",".join([*suffixes, *(s.upper() for s in suffixes)])
            return reader.option("pathGlobFilter", f"*.{{{both}}}").option("recursiveFileLookup", "true").load(image_dir)

        self.files = load("binaryFile", image_paths, SUFFIXES).select("path", "length", "content")
        if self.files.isEmpty():
            raise ValueError("No images found")
        # files that are not decoded here take the pixels of the second reader; it opens no others
        names = self.files.select("path").where(F.lower("path").rlike(OTHER))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("origin", "string"), ("height", "int"), ("width", "int"), ("nChannels", "int"), ("data", "binary"))]
        if names.isEmpty():
            self.read = self.files.select("*", *none)
        else:
            same = lambda c: F.regexp_replace(F.col(c), "^file:/+", "file:/")
            made = load("image", [x for x in image_paths if re.search(OTHER, x.lower())] if image_paths else None, OTHER_SUFFIXES).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
            rest = self.files.where(F.lower("path").rlike(OTHER)).withColumn("__p", same("path")).join(made.withColumn("__p", same("origin")), "__p", "left").drop("__p")
            self.read = self.files.where(~F.lower("path").rlike(OTHER)).select("*", *none).unionByName(rest)
        self.log: list[dict] = []

    def headers(self) -> DataFrame:
        """path, bytes, height, width, channels, digest of the pixels, unsupported; height is null for files that cannot be read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                files = list(zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True))
                pixels = [decoded(*x) for x in files]
                shape = [p.shape if p is not None else (None, None, None) for p in pixels]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([s[k] for s in shape], pa.int32()) for k in range(3)), pa.array([p.tobytes() if p is not None else None for p in pixels], pa.binary()), pa.array([p is None and unsupported(x[0]) for p, x in zip(pixels, files, strict=True)])], names=["path", "bytes", "height", "width", "channels", "pixels", "unsupported"])

        read = self.read.mapInArrow(run, "path string, bytes long, height int, width int, channels int, pixels binary, unsupported boolean")
        return read.select("path", "bytes", "height", "width", "channels", F.sha2("pixels", 256).alias("digest"), "unsupported")

    def detect(self) -> dict:
        h = self.headers()
        ok = F.col("height").isNotNull()
        found = fuse(h, {
            "total_images": F.count(F.lit(1)),
            "corrupted": F.count_if(~ok & ~F.col("unsupported")),
            "unsupported": F.count_if("unsupported"),
            "size_mismatch": F.count_if(ok & ((F.col("height") != self.size[0]) | (F.col("width") != self.size[1]))),
            "color_mode_issues": F.count_if(ok & (F.col("channels") != self.channels)),
            "wrong_format": F.count_if(~F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$")),
            "low_quality": F.count_if(F.col("bytes") < SMALL_FILE),
        })
        found["duplicates"] = h.where(ok).groupBy("digest", "height", "width").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).first()["d"]
        self.log.append({"action": "detect"} | found)
        return found

    def clean(self, remove_corrupted: bool = True, resize_images: bool = True, convert_mode: bool = True) -> DataFrame:
        """path, height, width, channels, pixels (bytes; float32 in 0..1 if normalize): one row for each image."""
        height, width, channels, normalize = *self.size, self.channels, self.normalize

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[list] = [[], [], [], [], []]
                for path, *file in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                    p = decoded(*file)
                    if p is None:
                        if unsupported(file[0]):
                            raise ValueError(f"No decoder for the format of image {path}; leave it out or convert it")
                        if not remove_corrupted:
                            raise ValueError(f"Cannot read image {path}")
                        continue
                    p = to_channels(p, channels) if convert_mode else p
                    p = resize(p, height, width) if resize_images else p
                    raw = (p.astype("<f4") / 255).astype("<f4").tobytes() if normalize else p.tobytes()
                    for column, v in zip(rows, (path, *p.shape, raw), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["path", "height", "width", "channels", "pixels"])

        self.log.append({"action": "clean", "size": list(self.size), "channels": channels})
        return self.read.mapInArrow(run, "path string, height int, width int, channels int, pixels binary")

    def to_array(self, images: DataFrame) -> np.ndarray:
        """All images in one array (n, height, width, channels) on the driver: for small sets."""
        kind = np.dtype("<f4") if self.normalize else np.dtype(np.uint8)
        rows = images.orderBy("path").collect()
        return np.stack([np.frombuffer(r["pixels"], kind).reshape(r["height"], r["width"], r["channels"]) for r in rows])

    def save_processed(self, images: DataFrame, output: str, prefix: str = "processed_") -> DataFrame:
        """Encode as PNG and write (name, content) as Parquet, a table that any store holds; returns it."""
        normalize = self.normalize

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, data = [], []
                for path, h, w, c, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    p = np.rint(np.frombuffer(raw, "<f4") * 255).astype(np.uint8) if normalize else np.frombuffer(raw, np.uint8)
                    names.append(prefix + path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".png")
                    data.append(encode_png(p.reshape(h, w, c)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["name", "content"])

        images.select("path", "height", "width", "channels", "pixels").mapInArrow(run, "name string, content binary").write.mode("overwrite").parquet(output)
        return self.spark.read.parquet(output)

    def save_files(self, images: DataFrame, folder: str, prefix: str = "processed_") -> int:
        """Write each image as a PNG file into a folder that all executors share; tasks write their own files. Returns how many."""
        table = self.save_processed(images, f"{folder.rstrip('/')}/_table", prefix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            store.create_dir(base, recursive=True)
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with store.open_output_stream(f"{base.rstrip('/')}/{name}") as out:
                        out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

        return table.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def get_statistics(self) -> dict:
        h = self.headers().where("height IS NOT NULL")
        sizes = h.groupBy("height", "width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "height", "width")
        modes = {MODES.get(r["channels"], str(r["channels"])): r["n"] for r in h.groupBy("channels").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = fuse(h, {"total_images": F.count(F.lit(1)), "min_bytes": F.min("bytes"), "max_bytes": F.max("bytes"), "avg_bytes": F.avg("bytes"), "total_mb": F.sum("bytes") / 2**20})
        return found | {"unique_sizes": sizes.count(), "top_sizes": [(r["height"], r["width"], r["n"]) for r in sizes.limit(5).collect()], "modes": modes}

    def split_dataset(self, images: DataFrame, shares: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> list[DataFrame]:
        return split_rows(images, shares, seed)

    def save_report(self, path: str) -> None:
        from millrace.sources.reports import save_report

        save_report({"issues": self.detect(), "statistics": self.get_statistics(), "logs": self.log}, path)


def preprocess_images(spark: SparkSession, image_dir: str, target_size: tuple[int, int] = (224, 224), color_mode: str = "rgb", normalize: bool = True, output: str | None = None) -> DataFrame:
    prep = ImagePrep(spark, image_dir, target_size=target_size, color_mode=color_mode, normalize=normalize)
    images = prep.clean()
    if output:
        prep.save_processed(images, output)
    return images
