"""Flat binary rasters as a Python data source: read by row blocks, written by files.

Formats: float32 (one band), float32x2 (two bands, each row holds the first band, then the second),
complex64, uint8. The header file beside it (name.rsc) gives the width and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"float32": (np.dtype("<f4"), 1), "float32x2": (np.dtype("<f4"), 2), "complex64": (np.dtype("<c8"), 1), "uint8": (np.dtype("u1"), 1)}
BLOCK_BYTES = 8 << 20


def open_path(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def header_of(path: str) -> dict[str, str]:
    fs, p = open_path(path)
    with fs.open_input_stream(f"{p}.rsc") as f:
        text = f.read().decode()
    return {k.lower(): v.strip() for k, _, v in (x.partition(" ") for x in text.splitlines()) if k}


class Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int, width: int) -> None:
        self.path, self.start, self.stop, self.width = path, start, stop, width


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.kind, self.band = KINDS[options.get("kind", "float32")], int(options.get("band", "1"))

    def partitions(self) -> list[Rows]:
        out = []
        for p in self.paths:
            h = header_of(p)
            width, length = int(h["width"]), int(h["file_length"])
            step = max(1, BLOCK_BYTES // (width * self.kind[0].itemsize * self.kind[1]))
            out += [Rows(p, a, min(length, a + step), width) for a in range(0, length, step)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        kind, bands = self.kind
        row = part.width * bands * kind.itemsize
        fs, p = open_path(part.path)
        with fs.open_input_file(p) as f:
            f.seek(part.start * row)
            raw = np.frombuffer(f.read((part.stop - part.start) * row), kind).reshape(-1, bands, part.width)
        v = raw[:, min(self.band, bands) - 1, :]
        n = v.shape[0]
        rows, cols = np.repeat(np.arange(part.start, part.start + n, dtype=np.int32), part.width), np.tile(np.arange(part.width, dtype=np.int32), n)
        flat = v.ravel()
        re, im = flat.real.astype(np.float64), flat.imag.astype(np.float64) if kind.kind == "c" else np.zeros(len(flat))
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(flat)), pa.array(rows), pa.array(cols), pa.array(re), pa.array(im)], ["path", "prow", "pcol", "value", "imag"])


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str) -> None:
        self.temporary, self.final = temporary, final


class RasterWriter(DataSourceWriter):
    """Each task holds whole images (repartition by path first); files appear under their names at commit. Options width and length
    give the shape; without them it's that of the pixels there are. Pixels that aren't there are zero."""

    def __init__(self, options: dict) -> None:
        self.folder, self.kind = options["path"], KINDS[options.get("kind", "float32")]
        self.shape = tuple(int(options[k]) if k in options else None for k in ("length", "width"))

    def write(self, rows) -> list | WriterCommitMessage:
        import uuid

        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r.path, []).append((r.prow, r.pcol, r.value))
        fs, folder = open_path(self.folder)
        fs.create_dir(folder, recursive=True)
        names = []
        for name, cells in held.items():
            a = np.array(cells)
            shape = tuple(given or int(a[:, k].max()) + 1 for k, given in enumerate(self.shape))
            image = np.zeros(shape, self.kind[0])
            image[a[:, 0].astype(int), a[:, 1].astype(int)] = a[:, 2]
            tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as f:
                f.write(image.tobytes())
            with fs.open_output_stream(f"{tmp}.rsc") as f:
                f.write(f"WIDTH {shape[1]}\nFILE_LENGTH {shape[0]}\n".encode())
            names.append((tmp, f"{folder}/{name}"))
        return Written("\n".join(t for t, _ in names), "\n".join(n for _, n in names))

    def commit(self, messages) -> None:
        fs, _ = open_path(self.folder)
        for m in filter(None, messages):
            for a, b in zip(m.temporary.split("\n"), m.final.split("\n")):
                if a:
                    fs.move(a, b)
                    fs.move(f"{a}.rsc", f"{b}.rsc")

    def abort(self, messages) -> None:
        fs, _ = open_path(self.folder)
        for m in filter(None, messages):
            for a in filter(None, m.temporary.split("\n")):
                fs.delete_file(a)
                fs.delete_file(f"{a}.rsc")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_raster"

    def schema(self) -> str:
        return "path string, prow int, pcol int, value double, imag double"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RasterWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
