"""Documents from files: which paths are taken, which reader they go to, raster images, TIFF and PDF pages, dictionaries."""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Readers by extension.
READERS = {"pdf": "pdf", "tif": "tiff", "tiff": "tiff", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "webp": "image"}
UNKNOWN = "desconocido"
PAGE_IMAGES = "doc_id string, page_no int, width long, height long, png binary, error string"
#: Pixels that a PDF page is rendered wide.
RENDER_WIDTH = 2000
# What a user is told of a path that is not taken.
EMPTY, NOT_FOUND, NOT_A_FILE, REFUSED = "Ruta de archivo vacia", "Archivo no encontrado: ", "La ruta no es un archivo: ", "Formato no soportado: ."
TAKEN = ("png", "jpg", "jpeg", "tiff", "tif", "pdf")
TAKEN_TEXT = " (soportados: PNG, JPEG, TIFF, PDF)"


class DocumentNotFound(FileNotFoundError):
    """There is nothing at a path."""


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1)), F.lit(""))


def routed(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with filename, source_format, and error for what no reader takes."""
    table = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])
    kind = extension(F.col(path))
    rows = paths.withColumns({"filename": F.element_at(F.split(F.col(path), "/"), -1), "source_format": F.try_element_at(table, kind)})
    return rows.withColumn("error", F.when(F.trim(F.col(path)) == "", "empty path").when(F.col("source_format").isNull(), F.concat(F.lit("UnsupportedFormat: "), F.coalesce(kind, F.lit(UNKNOWN)))))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and routing of the files under ``path``; a missing path is Spark's error."""
    return routed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


def file_status(spark: SparkSession, path: str):
    """What Hadoop's file system of ``path`` says of it; None where there is nothing. Any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(place) if system.exists(place) else None


def refusal(spark: SparkSession, path: str) -> str | None:
    """Why a single path is not taken for a job; None if it is."""
    if not path:
        return EMPTY
    status = file_status(spark, path)
    if status is None:
        return NOT_FOUND + path
    if not status.isFile():
        return NOT_A_FILE + path
    name = path.rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
    return None if kind in TAKEN else REFUSED + kind + TAKEN_TEXT


def admitted(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with refusal, by their names alone: what there is to be told before files are looked for."""
    kind = F.coalesce(extension(F.col(path)), F.lit(""))
    return paths.withColumn("refusal", F.when(F.coalesce(F.col(path), F.lit("")) == "", EMPTY).when(~kind.isin(*TAKEN), F.concat(F.lit(REFUSED), kind, F.lit(TAKEN_TEXT))))


def raster_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page an image, as PNG (``PAGE_IMAGES``); an image that the JVM cannot read is a row with its error."""

    def run(batches):
        from ..operators.raster import encode_png

        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.height <= 0 or r.width <= 0:
                    out.append((r.origin, None, None, None, None, "ImageError: not an image that can be read"))
                    continue
                pixels = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                pixels = pixels[..., 0] if r.channels == 1 else pixels[..., [2, 1, 0, *range(3, r.channels)]]  # the JVM's order is blue, green, red
                out.append((r.origin, 1, r.width, r.height, encode_png(np.ascontiguousarray(pixels)), None))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "width", "height", "png", "error"])

    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    rows = rows.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return rows.mapInPandas(run, PAGE_IMAGES)


def tiff_images(raw: bytes) -> list[np.ndarray]:
    """The pages of a TIFF: 8-bit gray, gray with alpha, RGB, RGBA; plain, PackBits, deflate or LZW, in strips or tiles."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, out = struct.unpack(order + "I", raw[4:8])[0], []
    sizes = {1: 1, 2: 1, 3: 2, 4: 4}
    while at:
        n = struct.unpack(order + "H", raw[at : at + 2])[0]
        tags = {}
        for k in range(n):
            e = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", e[:8])
            size = sizes.get(kind, 0) * count
            place = e[8 : 8 + size] if size <= 4 else raw[(p := struct.unpack(order + "I", e[8:12])[0]) : p + size]
            if kind in (3, 4):
                tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I") * count, place)
        wide, high = tags[256][0], tags[257][0]
        channels = tags.get(277, (1,))[0]
        if set(tags.get(258, (1,))) != {8} or channels not in (1, 2, 3, 4) or set(tags.get(339, (1,))) != {1}:
            raise ValueError(f"page {len(out) + 1}: only unsigned 8-bit samples are read")
        if channels > 1 and tags.get(284, (1,))[0] != 1:
            raise ValueError(f"page {len(out) + 1}: samples in planes of their own are not read")
        tiled = 322 in tags
        part_wide, part_high = (tags[322][0], tags[323][0]) if tiled else (wide, tags.get(278, (high,))[0] or high)
        pixels, across = np.zeros((high, wide, channels), dtype=np.uint8), -(-wide // part_wide)
        for k, (o, c) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
            y, x = k // across * part_high, k % across * part_wide
            rows = part_high if tiled else min(part_high, high - y)
            if rows <= 0:
                break
            part = np.frombuffer(unpacked(raw[o : o + c], tags.get(259, (1,))[0])[: rows * part_wide * channels], dtype=np.uint8).reshape(rows, part_wide, channels)
            if tags.get(317, (1,))[0] == 2:  # each sample is told by how it differs from the one before
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            pixels[y : y + rows, x : x + part_wide] = part[: high - y, : wide - x]
        out.append(pixels[..., 0] if channels == 1 else pixels)
        at = struct.unpack(order + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    if not out:
        raise ValueError("a TIFF without pages")
    return out


def unpacked(strip: bytes, compression: int) -> bytes:
    if compression == 1:
        return strip
    if compression in (8, 32946):
        import zlib

        return zlib.decompress(strip)
    if compression == 32773:
        out, k = bytearray(), 0
        while k < len(strip):
            n = strip[k]
            if n < 128:
                out += strip[k + 1 : k + 2 + n]
                k += n + 2
            else:
                out += strip[k + 1 : k + 2] * (257 - n if n > 128 else 0)
                k += 2
        return bytes(out)
    if compression == 5:
        return lzw(strip)
    raise ValueError(f"compression {compression} is not read")


def lzw(strip: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, before, wide = list(first), bytearray(), b"", 9
    held = bits = 0
    for byte in strip:
        held, bits = held << 8 | byte, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, wide, before = list(first), 9, b""
            continue
        if code > len(table) or code == len(table) and not before:
            raise ValueError("a broken LZW strip")
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        wide = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def tiff_pages(contents: DataFrame) -> DataFrame:
    """Pages of ``contents`` (path, content), numbered from 1, as PNG; a file that cannot be read is a row with its error."""

    def run(batches):
        from ..operators.raster import encode_png

        for rows in batches:
            out = []
            for r in rows.itertuples():
                try:
                    out += [(r.path, k, p.shape[1], p.shape[0], encode_png(p), None) for k, p in enumerate(tiff_images(r.content), 1)]
                except (ValueError, KeyError, struct.error) as e:
                    out.append((r.path, None, None, None, None, f"ImageError: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "width", "height", "png", "error"])

    return contents.select("path", "content").mapInPandas(run, PAGE_IMAGES)


class Renderer(Protocol):
    """What turns a PDF into pictures; made once a task."""

    def pages(self, content: bytes) -> int: ...

    def render(self, content: bytes, page_no: int, width: int) -> np.ndarray: ...


class BlankRenderer:
    """Stands in where no renderer is at hand: pages of the right shape without anything on them."""

    def boxes(self, content: bytes) -> list[tuple[float, float]]:
        import re

        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        number = rb"\s*(-?[\d.]+)"
        found = re.findall(rb"/MediaBox\s*\[" + number * 4 + rb"\s*\]", content)
        return [(float(c) - float(a), float(d) - float(b)) for a, b, c, d in found]

    def pages(self, content: bytes) -> int:
        return len(self.boxes(content))

    def render(self, content: bytes, page_no: int, width: int) -> np.ndarray:
        wide, high = self.boxes(content)[page_no - 1]
        return np.full((max(1, round(width * high / wide)), width), 255, dtype=np.uint8)


def pdf_pages(contents: DataFrame, renderer: Callable[[], Renderer] | None = None, width: int = RENDER_WIDTH) -> DataFrame:
    """Pages of ``contents`` (path, content), numbered from 1, rendered ``width`` pixels wide. Pages are counted first and dealt out one by
    one, so a long file is many tasks' work; a file or page that cannot be read is a row with its error, as is every file where there is no renderer."""
    files_ = contents.select(F.col("path").alias("doc_id"), "content")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("page_no", "int"), ("width", "long"), ("height", "long"), ("png", "binary"))]
    if renderer is None:
        return files_.select("doc_id", *nothing, F.lit("PdfError: no renderer").alias("error"))

    def count(batches):
        own = renderer()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                try:
                    out.append((r.doc_id, own.pages(r.content), None))
                except Exception as e:  # a renderer may fail in its own way
                    out.append((r.doc_id, None, f"PdfError: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "n", "error"]).astype({"n": "Int32"})

    def draw(batches):
        from ..operators.raster import encode_png

        own = renderer()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                try:
                    pixels = own.render(r.content, r.page_no, width)
                    out.append((r.doc_id, r.page_no, pixels.shape[1], pixels.shape[0], encode_png(pixels), None))
                except Exception as e:
                    out.append((r.doc_id, r.page_no, None, None, None, f"PdfError: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "width", "height", "png", "error"]).astype({"page_no": "Int32", "width": "Int64", "height": "Int64"})

    counted = files_.mapInPandas(count, "doc_id string, n int, error string")
    failed = counted.filter("error is not null or n <= 0").select("doc_id", *nothing, F.coalesce("error", F.lit("PdfError: no pages")).alias("error"))
    pages = counted.filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page_no")).repartition("doc_id", "page_no")
    return pages.join(files_, "doc_id").select("doc_id", "page_no", "content").mapInPandas(draw, PAGE_IMAGES).unionByName(failed)


def scan(spark: SparkSession, path: str, renderer: Callable[[], Renderer] | None = None) -> DataFrame:
    """The pages of every file under ``path`` (a file, folder or pattern) as PNG: doc_id (the file's path), page_no, width, height, png, filename,
    source_format and error. Files no reader takes, and pages that cannot be read, are rows with their error."""
    if not any(c in path for c in "*?[{") and file_status(spark, path) is None:
        raise DocumentNotFound(path)
    plain = lambda p: F.regexp_replace(p, "^file:/*", "file:/")  # noqa: E731  readers write local paths in two ways
    found = files(spark, path).withColumn("path", plain(F.col("path")))
    names = found.select(F.col("path").alias("doc_id"), "filename", "source_format")
    pages = tiff_pages(found.filter("source_format = 'tiff'")).unionByName(pdf_pages(found.filter("source_format = 'pdf'"), renderer))
    images = found.filter("source_format = 'image'").select("path")
    if not images.isEmpty():
        raster = raster_pages(spark, path)
        pages = pages.unionByName(raster.withColumn("doc_id", plain(F.col("doc_id"))).join(images, F.col("doc_id") == images["path"], "left_semi"))
    refused = found.filter("error is not null").select(F.col("path").alias("doc_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("page_no", "int"), ("width", "long"), ("height", "long"), ("png", "binary"))], "error")
    return pages.unionByName(refused).join(names, "doc_id").select("doc_id", "page_no", "width", "height", "png", "filename", "source_format", "error")


def stub_document(spark: SparkSession, doc_id: int = 0) -> DataFrame:
    """One page of two empty blocks, as fixed for tests."""
    from ..schema import BLOCKS

    rows = [(doc_id, 1, k, kind, 100, y, 2280, h, "", 0.0, None, k, 2480, 3508, False, None) for k, (kind, y, h) in enumerate((("Title", 100, 80), ("Text", 250, 400)))]
    return spark.createDataFrame(rows, BLOCKS)


def dictionary(spark: SparkSession, path: str) -> list[str]:
    """A recogniser's characters, one a line in the order of the file. The file is read whole: it is a model's, of fixed size."""
    return spark.read.option("wholetext", True).text(path).first()[0].split("\n")


def missing_artefacts(registry: DataFrame, contents: DataFrame) -> DataFrame:
    """Names of ``registry`` (name, sha256 or null) that are not among ``contents`` (filename, content) with that hash."""
    have = contents.select(F.col("filename").alias("name"), F.sha2("content", 256).alias("found"))
    return registry.join(have, (registry["name"] == have["name"]) & F.coalesce(registry["sha256"] == have["found"], F.lit(True)), "left_anti")
