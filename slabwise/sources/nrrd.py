"""A Spark data source of NRRD volumes as voxel rows.

    spark.dataSource.register(NrrdSource)
    spark.read.format("nrrd").load("/folder")

Each file is one partition: (patient, y, x, z, hu). Raw and gzip encodings of attached data;
axes are taken as x fastest, z slowest, the order of the format."""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element types of the format.
TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8",
}


def parse(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(volume indexed [z, y, x], header fields)."""
    head, _, body = raw.partition(b"\n\n")
    lines = head.decode("ascii", "replace").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x and not x.startswith("#"))
    if fields.get("encoding") in ("gzip", "gz"):
        body = gzip.decompress(body)
    kind = TYPES[fields["type"].strip()]
    order = ">" if fields.get("endian", "little").strip() == "big" else "<"
    shape = [int(n) for n in fields["sizes"].split()]
    return np.frombuffer(body, np.dtype(order + kind), int(np.prod(shape))).reshape(shape[::-1]).astype(np.float32), fields


def axes_of(fields: dict[str, str]) -> list[tuple[int, int]]:
    """(anatomical axis, direction) of each file axis from the header: axis 0 runs to the left, 1 to the
    back, 2 to the top, direction 1 along it and -1 against it. Without directions the file's
    axes are taken as they are."""
    directions = fields.get("space directions", "")
    vectors = [[float(v) for v in d.split(",")] for d in re.findall(r"\(([^)]*)\)", directions)]
    if len(vectors) != 3:
        return [(0, 1), (1, 1), (2, 1)]
    space = fields.get("space", "left-posterior-superior").strip().lower()
    names = {"lps": "left-posterior-superior", "ras": "right-anterior-superior", "las": "left-anterior-superior"}.get(space, space).split("-")
    sign = [-1 if n in ("right", "anterior", "inferior") else 1 for n in names[:3]]
    free, out = {0, 1, 2}, {}
    for i in sorted(range(3), key=lambda i: -max(map(abs, vectors[i]))):
        a = max(free, key=lambda a: abs(vectors[i][a]))
        free.discard(a)
        out[i] = (a, 1 if vectors[i][a] * sign[a] >= 0 else -1)
    return [out[i] for i in range(3)]


def orientation(fields: dict[str, str]) -> str:
    """Three letters, one per file axis: where it runs to."""
    return "".join("LPS"[a] if d > 0 else "RAI"[a] for a, d in axes_of(fields))


def oriented(volume: np.ndarray, fields: dict[str, str]) -> np.ndarray:
    """A volume indexed [z, y, x] with x to the left, y to the back and z to the top, from one in file order."""
    v, axes = volume.transpose(2, 1, 0), axes_of(fields)
    v = v.transpose([next(i for i in range(3) if axes[i][0] == a) for a in range(3)])
    for a in range(3):
        if next(d for x, d in axes if x == a) < 0:
            v = np.flip(v, a)
    return np.ascontiguousarray(v.transpose(2, 1, 0))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "**", "*.nrrd"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            volume, fields = parse(f.read())
        volume = oriented(volume, fields)
        patient = os.path.splitext(os.path.basename(partition.value))[0]
        y, x = (a.ravel().astype(np.int32) for a in np.indices(volume.shape[1:]))
        for z in range(volume.shape[0]):
            n = len(y)
            yield pa.RecordBatch.from_arrays([pa.array([patient] * n), pa.array(y), pa.array(x), pa.array(np.full(n, z, np.int32)), pa.array(volume[z].ravel())], ["patient", "y", "x", "z", "hu"])


class NrrdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return "patient string, y int, x int, z int, hu float"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"])
