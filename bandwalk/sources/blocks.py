"""A data source for packed vector files: every partition reads a run of whole records of one file."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: dtype of each kind of file (fixed by the formats)
KINDS = {"fvecs": "<f4", "u8bin": "u1", "i8bin": "i1"}
BLOCK_BYTES = 32 << 20
SLICE_ROWS = 50_000


def opened(path: str):
    """The file system of a path or URI, and the place in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str, kind: str) -> list[tuple[str, int]]:
    """Names and sizes: the file itself, or a folder's files of the kind in name order."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(f".{kind}"))
    if info.type != fs.FileType.File:
        raise ValueError(f"no such file: {path}")
    return [(info.path, info.size)]


@dataclass
class Run(InputPartition):
    """``rows`` records of a file from byte ``start``; the first has id ``first``."""

    file: str
    start: int
    rows: int
    dim: int
    first: int


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.block = int(options.get("block_bytes", BLOCK_BYTES))

    def partitions(self):
        store, _ = opened(self.path)
        out, first = [], 0
        for name, size in files_of(self.path, self.kind):
            if self.kind == "fvecs" and not size:
                continue
            with store.open_input_file(name) as f:
                head = f.read(8)
            if self.kind == "fvecs":
                dim = int(np.frombuffer(head[:4], "<i4")[0]) if len(head) >= 4 else 0
                record, start = 4 + 4 * dim, 0
                if dim <= 0 or size % record:
                    raise ValueError(f"{name}: not whole records of dimension {dim}")
                n = size // record
            else:
                n, dim = np.frombuffer(head, "<u4" if self.kind == "u8bin" else "<i4").tolist() if len(head) == 8 else (-1, -1)
                record, start = dim, 8
                if self.kind == "i8bin" and (n <= 0 or dim <= 0) or size != 8 + n * dim:
                    raise ValueError(f"{name}: size does not match its header")
            step = max(1, self.block // max(1, record))
            out += [Run(name, start + i * record, min(step, n - i), dim, first + i) for i in range(0, n, step)]
            first += n
        return out or [Run("", 0, 0, 1, 0)]

    def read(self, run):
        import pyarrow as pa

        if not run.rows:
            return
        store, _ = opened(self.path)
        width = 4 + 4 * run.dim if self.kind == "fvecs" else run.dim
        with store.open_input_file(run.file) as f:
            for i in range(0, run.rows, SLICE_ROWS):
                n = min(SLICE_ROWS, run.rows - i)
                raw = np.frombuffer(f.read_at(n * width, run.start + i * width), np.uint8).reshape(n, width)
                if self.kind == "fvecs":
                    if (np.ascontiguousarray(raw[:, :4]).view("<i4") != run.dim).any():
                        raise ValueError(f"{run.file}: dimensions differ")
                    raw = np.ascontiguousarray(raw[:, 4:])
                x = raw.view(KINDS[self.kind]).astype(np.float32)
                at = np.arange(n + 1, dtype=np.int32) * run.dim
                ids = np.arange(run.first + i, run.first + i + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], names=["vec_id", "embedding"])


class VectorSource(DataSource):
    @classmethod
    def name(cls):
        return "packed_vectors"

    def schema(self):
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        return VectorReader(self.options)
