"""Image files as rasters: NPY, ICS, TIFF (uncompressed, PackBits, deflate) and PNG, read through ``binaryFile``.

Files are read by Spark, from any store that it reaches, and decoded inside tasks; headers are read
without pixels.  Readers give (path, image_id, coordinates, v); the image's number is its place in
the order of paths.  JPEG needs an imaging library and is read only where one is installed.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..raster import DIMS, ID, Raster

#: The first bytes of each format.
MAGIC = {"npy": b"\x93NUMPY", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "tiff": b"II*\x00", "tiff-be": b"MM\x00*", "ics": b"\t\n", "ics2": b"\t\r\n"}
#: Extensions that name a format.
EXTENSIONS = {"npy": "npy", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "ics": "ics"}


# --- names ---------------------------------------------------------------------------------------


def get_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def has_extension(path: Column) -> Column:
    return path.rlike(r"\.[^./]+$")


def compare_extension(path: Column, extension: str) -> Column:
    return F.lower(get_extension(path)) == extension.lower()


def add_extension(path: Column, extension: str) -> Column:
    return F.when(has_extension(path), path).otherwise(append_extension(path, extension))


def append_extension(path: Column, extension: str) -> Column:
    return F.concat(path, F.lit(f".{extension}"))


# --- formats -------------------------------------------------------------------------------------


def kind_of(path: str, head: bytes) -> str:
    """Format by content, else by extension."""
    for kind, magic in MAGIC.items():
        if head.startswith(magic):
            return {"tiff-be": "tiff", "ics2": "ics"}.get(kind, kind)
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "")


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def write_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def info_npy(data: bytes) -> tuple[tuple[int, ...], str]:
    with io.BytesIO(data) as f:
        version = np.lib.format.read_magic(f)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return shape[::-1], str(dtype)


def _png_chunks(data: bytes):
    at = 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def read_png(data: bytes) -> np.ndarray:
    """Grey, colour, palette and alpha images of 1 to 16 bits without interlacing: [y, x] or [y, x, channel]."""
    chunks, body = {}, b""
    for name, content in _png_chunks(data):
        if name == b"IDAT":
            body += content
        else:
            chunks[name] = content
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced PNG files aren't read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step, row = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, row + 1)
    out = np.zeros((h, row), np.uint8)
    before = np.zeros(row, np.int64)
    for y in range(h):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 2:
            line = line + before
        elif rule in (1, 3, 4):
            line = line.tolist()
            up = before.tolist()
            for x in range(row):
                a, c = (line[x - step], up[x - step]) if x >= step else (0, 0)
                b = up[x]
                if rule == 1:
                    add = a
                elif rule == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + add) & 255
            line = np.array(line, np.int64)
        before = line & 255
        out[y] = before
    if depth == 16:
        values = out.reshape(h, -1, 2).astype(np.int64) @ [256, 1]
    elif depth == 8:
        values = out.astype(np.int64)
    else:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        values = bits.astype(np.int64) @ (1 << np.arange(depth)[::-1])
    values = values.reshape(h, w, channels)
    if kind == 3:
        return np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[values[..., 0]]
    return values[..., 0] if channels == 1 else values


def write_png(array: np.ndarray, level: int = 6) -> bytes:
    """8 or 16 bits, grey or with 2 to 4 channels."""
    wide = array.max(initial=0) > 255
    a = np.clip(array, 0, 65535 if wide else 255).astype(">u2" if wide else np.uint8)
    h, w = a.shape[:2]
    channels = a.shape[2] if a.ndim > 2 else 1
    lines = a.reshape(h, -1).view(np.uint8)
    body = np.concatenate([np.zeros((h, 1), np.uint8), lines], 1).tobytes()

    def chunk(name: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))

    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return MAGIC["png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, level)) + chunk(b"IEND", b"")


def info_png(data: bytes) -> tuple[tuple[int, ...], str]:
    w, h, depth, _ = struct.unpack_from(">IIBB", data, 16)
    return (w, h), f"uint{max(depth, 8)}"


#: TIFF field types and their sizes in bytes.
_TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def _tiff_pages(data: bytes):
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    while at:
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            code, size = _TIFF_TYPES.get(kind, ("B", 1))
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = struct.unpack_from(e + "I", data, place)
            tags[tag] = [x for i in range(count) for x in struct.unpack_from(e + code, data, place + i * size)]
        yield e, tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def read_tiff(data: bytes, page: int = 0) -> np.ndarray:
    """One page of strips or tiles; no, PackBits or deflate compression; palettes become colours."""
    e, t = list(_tiff_pages(data))[page]
    w, h = t[256][0], t[257][0]
    bits, channels = t.get(258, [1])[0], t.get(277, [1])[0]
    form = {1: "u", 2: "i", 3: "f"}[t.get(339, [1])[0]]
    unpack: Callable[[bytes], bytes] = {1: bytes, 32773: _unpackbits, 8: zlib.decompress, 32946: zlib.decompress}.get(t.get(259, [1])[0])
    if unpack is None:
        raise ValueError(f"TIFF compression {t[259][0]} isn't read")
    dtype = np.dtype(f"{e}{form}{bits // 8}") if bits >= 8 else np.uint8

    def block(content: bytes, rows: int, cols: int) -> np.ndarray:
        if bits < 8:
            line = (cols * bits * channels + 7) // 8
            raw = np.unpackbits(np.frombuffer(content, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : cols * bits * channels]
            return raw.reshape(rows, cols, channels, bits) @ (1 << np.arange(bits)[::-1])
        v = np.frombuffer(content, dtype, rows * cols * channels).reshape(rows, cols, channels)
        return np.cumsum(v, 1, dtype=dtype) if t.get(317, [1])[0] == 2 else v

    out = np.zeros((h, w, channels), np.float64 if form == "f" else np.int64)
    if 324 in t:
        tw, th = t[322][0], t[323][0]
        across = -(-w // tw)
        for k, (o, n) in enumerate(zip(t[324], t[325])):
            y, x = k // across * th, k % across * tw
            b = block(unpack(data[o : o + n]), th, tw)
            out[y : y + th, x : x + tw] = b[: h - y, : w - x]
    else:
        per = min(t.get(278, [h])[0], h)
        for k, (o, n) in enumerate(zip(t[273], t[279])):
            rows = min(per, h - k * per)
            out[k * per : k * per + rows] = block(unpack(data[o : o + n]), rows, w)
    if t.get(262, [1])[0] == 3:
        return (np.array(t[320]).reshape(3, -1).T // 257)[out[..., 0]]
    return out[..., 0] if channels == 1 else out


def write_tiff(array: np.ndarray, compression: str = "") -> bytes:
    """One page in one strip; "deflate" or none."""
    a = np.asarray(array)
    a = a.astype("<f4") if a.dtype.kind == "f" else a.astype("<u2" if a.max(initial=0) > 255 else np.uint8)
    h, w = a.shape[:2]
    channels = a.shape[2] if a.ndim > 2 else 1
    body = a.tobytes()
    body = zlib.compress(body) if compression == "deflate" else body
    bits = a.dtype.itemsize * 8
    fields = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 8 if compression == "deflate" else 1), (262, 3, 2 if channels == 3 else 1), (273, 4, 8), (277, 3, channels), (278, 4, h), (279, 4, len(body)), (339, 3, 3 if a.dtype.kind == "f" else 1)]
    pad = len(body) % 2
    table = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in fields)
    return b"II*\x00" + struct.pack("<I", 8 + len(body) + pad) + body + b"\x00" * pad + table + struct.pack("<I", 0)


def info_tiff(data: bytes) -> tuple[tuple[int, ...], str]:
    _, t = next(_tiff_pages(data))
    return (t[256][0], t[257][0]), f"{ {1: 'uint', 2: 'int', 3: 'float'}[t.get(339, [1])[0]]}{t.get(258, [1])[0]}"


def tiff_pages(data: bytes) -> int:
    return sum(1 for _ in _tiff_pages(data))


def _ics_header(data: bytes) -> tuple[dict[str, list[str]], int]:
    """Fields by name, and where pixels begin in a file of version 2."""
    field = data[0:1].decode()
    line_end = data[1:2].decode() if data[1:2] != b"\r" else "\n"
    out, at = {}, 0
    while True:
        end = data.find(line_end.encode(), at)
        if end < 0:
            return out, len(data)
        line = data[at:end].decode("latin-1").strip("\r")
        at = end + 1
        parts = [p for p in re.split(f"[{re.escape(field)} ]", line) if p]
        if parts and parts[0] == "end":
            return out, at
        if len(parts) > 1:
            name = " ".join(parts[:2]) if parts[0] in ("layout", "representation", "parameter", "source") else parts[0]
            out.setdefault(name, parts[2 if " " in name else 1 :])


def read_ics(data: bytes, pixels: bytes | None = None) -> np.ndarray:
    """Version 2, or version 1 with the pixels of its second file; gzip or no compression."""
    import gzip

    h, at = _ics_header(data)
    order = h["layout order"]
    sizes = dict(zip(order, map(int, h["layout sizes"])))
    bits = sizes.pop("bits")
    form, sign = h.get("representation format", ["integer"])[0], h.get("representation sign", ["unsigned"])[0]
    code = "f" if form == "real" else "c" if form == "complex" else "i" if sign == "signed" else "u"
    little = h.get("representation byte_order", ["1"])[0] == "1"
    body = pixels if pixels is not None else data[at:]
    if h.get("representation compression", ["uncompressed"])[0] == "gzip":
        body = gzip.decompress(body)
    dims = [d for d in order if d != "bits"]
    a = np.frombuffer(body, np.dtype(f"{'<' if little else '>'}{code}{bits // 8}"), int(np.prod([sizes[d] for d in dims])))
    return a.reshape([sizes[d] for d in dims][::-1])


def write_ics(array: np.ndarray, history: tuple[str, ...] = ()) -> bytes:
    """Version 2, uncompressed."""
    a = np.asarray(array)
    a = a.astype("<f8") if a.dtype.kind == "f" else a.astype("<u2" if a.max(initial=0) > 255 else np.uint8)
    names = ["bits", *DIMS[: a.ndim]]
    sizes = [a.dtype.itemsize * 8, *a.shape[::-1]]
    lines = [
        ["ics_version", "2.0"], ["filename", "image"], ["layout", "parameters", str(len(names))], ["layout", "order", *names], ["layout", "sizes", *map(str, sizes)],
        ["layout", "significant_bits", str(sizes[0])], ["representation", "format", "real" if a.dtype.kind == "f" else "integer"], ["representation", "sign", "signed" if a.dtype.kind == "f" else "unsigned"],
        ["representation", "compression", "uncompressed"], ["representation", "byte_order", *map(str, range(1, a.dtype.itemsize + 1))],
        *[["history", x] for x in history], ["end"],
    ]
    return ("\t\n" + "\n".join("\t".join(x) for x in lines) + "\n").encode() + a.tobytes()


def info_ics(data: bytes) -> tuple[tuple[int, ...], str]:
    h, _ = _ics_header(data)
    sizes = dict(zip(h["layout order"], map(int, h["layout sizes"])))
    bits = sizes.pop("bits")
    return tuple(sizes.values()), f"{h.get('representation format', ['integer'])[0]}{bits}"


def read_jpeg(data: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("JPEG files need an imaging library, which isn't installed") from e
    return np.asarray(Image.open(io.BytesIO(data)))


def info_jpeg(data: bytes) -> tuple[tuple[int, ...], str]:
    """Sizes from the frame header."""
    at = 2
    while at < len(data):
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return (w, h), "uint8"
        at += 2 + n
    raise ValueError("no frame header")


READERS = {"npy": read_npy, "png": read_png, "tiff": read_tiff, "ics": read_ics, "jpeg": read_jpeg}
INFOS = {"npy": info_npy, "png": info_png, "tiff": info_tiff, "ics": info_ics, "jpeg": info_jpeg}
WRITERS = {"npy": write_npy, "png": write_png, "tiff": write_tiff, "ics": write_ics}


# --- readers and writers ------------------------------------------------------------------------


def is_kind(content: Column, kind: str) -> Column:
    """Whether files' contents begin as the format does."""
    heads = [MAGIC[k] for k in MAGIC if k.startswith(kind)]
    out = F.lit(False)
    for h in heads:
        out = out | (F.substring(content, 1, len(h)) == F.lit(bytearray(h)))
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, directories or patterns."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def image_information(spark: SparkSession, path: str, format: str = "") -> DataFrame:
    """(path, kind, sizes, sample_type) without decoding pixels."""

    @F.pandas_udf("kind string, sizes array<int>, sample_type string")
    def info(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(paths, contents):
            kind = format or kind_of(p, c[:16])
            sizes, sample = INFOS[kind](c)
            rows.append((kind, [int(n) for n in sizes], sample))
        return pd.DataFrame(rows, columns=["kind", "sizes", "sample_type"])

    return files(spark, path).select("path", info("path", "content").alias("i")).select("path", "i.*")


def image_read(spark: SparkSession, path: str, sizes: tuple[int, ...], format: str = "", roi: list[tuple[int, int]] | None = None) -> Raster:
    """Scalar images of equal ``sizes`` (x first), numbered by path; a region (low, high) per dimension leaves the rest undecoded to rows."""
    found = files(spark, path)
    numbers = found.select("path").select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias(ID))
    joined = found.join(numbers, "path").select(ID, "path", "content")
    dims = DIMS[: len(sizes)]
    box = roi or [(0, n - 1) for n in sizes]

    def decode(batches):
        from ..plans.engine import to_frame

        for batch in batches:
            for k, p, c in zip(batch[ID], batch["path"], batch["content"]):
                a = np.asarray(READERS[format or kind_of(p, bytes(c[:16]))](bytes(c)), float)
                a = a[tuple(slice(lo, hi + 1) for lo, hi in box[::-1])]
                out = to_frame(a, dims)
                out.insert(0, ID, k)
                yield out

    schema = ", ".join([f"{ID} long", *(f"{d} int" for d in dims), "v double"])
    return Raster(joined.mapInPandas(decode, schema), tuple(hi - lo + 1 for lo, hi in box))


def image_read_tiff_series(spark: SparkSession, path: str, sizes: tuple[int, int]) -> Raster:
    """Two-dimensional files stacked along z in the order of their paths, as one image."""
    r = image_read(spark, path, sizes, "tiff")
    n = r.df.select(ID).distinct().count()
    return Raster(r.df.select(F.lit(0).cast("long").alias(ID), "x", "y", F.col(ID).cast("int").alias("z"), "v"), (*sizes, n))


def encoded(r: Raster, format: str = "npy", integer: bool = False, **options) -> DataFrame:
    """(image_id, content): each image as a file's bytes."""
    from ..plans.engine import to_array

    dims, sizes, writer = r.dims, r.sizes, WRITERS[format]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a = to_array(frame, dims, sizes)
        return pd.DataFrame({ID: [key[0]], "content": [writer(np.round(a).astype(np.int64) if integer else a, **options)]})

    return r.df.select(*r.keys, F.col(r.value).alias("v")).groupBy(ID).applyInPandas(run, f"{ID} long, content binary")


def image_write(r: Raster, path: str, format: str = "npy", integer: bool = False, **options) -> None:
    """One file an image, ``<path>/<image_id>.<format>``, through the file system that the path names."""
    table = encoded(r, format, integer, **options)
    spark = r.spark
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in table.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{row[ID]}.{format}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(row["content"]))
        out.close()


def measurement_write_csv(table: DataFrame, path: str, simple: bool = False, units: dict[str, str] | None = None) -> None:
    """A measurement table as CSV with one header; names carry their value and unit unless simple."""
    names = []
    for c in table.columns:
        unit = (units or {}).get(c, "")
        names.append(c if simple else c.replace(".", " ") + (f" ({unit})" if unit else ""))
    table.toDF(*names).write.mode("overwrite").option("header", True).csv(path)
