"""Gaussian splats in PLY files: binary little-endian, plain or compressed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.spherical import C0
from voxloom.operators.splats import activate, deactivate

#: Fixed names of the format's scalar types.
_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_DEGREES = {0: 0, 9: 1, 24: 2, 45: 3}  # number of f_rest properties: degree
_CHUNK = 256
_ROWS = 1 << 16
RAW_SCHEMA = "path string, gid long, px double, py double, pz double, dc0 double, dc1 double, dc2 double, rest array<array<double>>, opacity_raw double, sx double, sy double, sz double, qw double, qx double, qy double, qz double"
_SCALARS = ["px", "py", "pz", "dc0", "dc1", "dc2", "opacity_raw", "sx", "sy", "sz", "qw", "qx", "qy", "qz"]


@dataclass
class Header:
    elements: dict[str, tuple[int, np.dtype]]  # name: number of rows and their layout
    starts: dict[str, int]


def parse_header(data: bytes) -> Header:
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply\n") or end < 0:
        raise ValueError("not a PLY file")
    elements: dict[str, tuple[int, list[tuple[str, str]]]] = {}
    name = None
    for line in data[:end].decode("ascii", "replace").split("\n")[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            if words[1:] != ["binary_little_endian", "1.0"]:
                raise ValueError("only binary little-endian PLY files are supported")
        elif words[0] == "element":
            name = words[1]
            elements[name] = (int(words[2]), [])
        elif words[0] == "property":
            if words[1] == "list" or words[1] not in _TYPES or name is None:
                raise ValueError(f"unsupported PLY property: {line}")
            elements[name][1].append((words[2], _TYPES[words[1]]))
        else:
            raise ValueError(f"unknown PLY header line: {line}")
    at, starts, found = end + len(b"end_header\n"), {}, {}
    for name, (n, fields) in elements.items():
        starts[name] = at
        found[name] = (n, np.dtype(fields))
        at += n * found[name][1].itemsize
    if at > len(data):
        raise ValueError("the PLY file is cut off")
    return Header(found, starts)


def _rows(data: bytes, header: Header, name: str, first: int, last: int) -> np.ndarray:
    n, layout = header.elements[name]
    return np.frombuffer(data, layout, min(last, n) - first, header.starts[name] + first * layout.itemsize)


def _need(rows: np.ndarray, names: list[str]) -> list[np.ndarray]:
    if missing := [n for n in names if n not in rows.dtype.names]:
        raise ValueError(f"the PLY file lacks {', '.join(missing)}")
    return [rows[n].astype(np.float64) for n in names]


def _unit(q: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(q, axis=0)
    good = np.isfinite(norm) & (norm > 1e-12)
    return np.where(good, q / np.where(good, norm, 1), np.array([[1.0], [0], [0], [0]]))


def _rest_count(layout: np.dtype) -> int:
    n = 0
    while f"f_rest_{n}" in (layout.names or ()):
        n += 1
    return n


def _spread(bits: np.ndarray, shift: int, width: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A packed number between its chunk's bounds."""
    most = (1 << width) - 1
    return lo + (hi - lo) * (((bits >> np.uint32(shift)) & np.uint32(most)) / most)


def _plain(rows: np.ndarray) -> dict[str, np.ndarray]:
    out = dict(zip(("px", "py", "pz"), _need(rows, ["x", "y", "z"]), strict=True))
    out |= {f"dc{i}": rows[f"f_dc_{i}"].astype(np.float64) if f"f_dc_{i}" in rows.dtype.names else np.zeros(len(rows)) for i in range(3)}
    out |= dict(zip(("opacity_raw", "sx", "sy", "sz"), _need(rows, ["opacity", "scale_0", "scale_1", "scale_2"]), strict=True))
    return out | dict(zip(("qw", "qx", "qy", "qz"), _unit(np.stack(_need(rows, ["rot_0", "rot_1", "rot_2", "rot_3"]))), strict=True))


def _packed(rows: np.ndarray, chunks: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """Chunks of 256 rows give the bounds between which positions (11, 10, 11 bits), logarithms of scales (likewise)
    and colours (8 bits each) lie; a rotation leaves out its largest component (2 bits say which)."""
    of = (first + np.arange(len(rows))) // _CHUNK
    if len(of) and of[-1] >= len(chunks):
        raise ValueError("the PLY file has too few chunks")
    own = chunks[of]
    bound = lambda side, what: own[f"{side}_{what}"].astype(np.float64)
    p, r, s, c = (rows[f"packed_{n}"].astype(np.uint32) for n in ("position", "rotation", "scale", "color"))
    out = {}
    for axis, shift, width in (("x", 21, 11), ("y", 11, 10), ("z", 0, 11)):
        out[f"p{axis}"] = _spread(p, shift, width, bound("min", axis), bound("max", axis))
        out[f"s{axis}"] = _spread(s, shift, width, bound("min", f"scale_{axis}"), bound("max", f"scale_{axis}"))
    for i, (name, shift) in enumerate((("r", 24), ("g", 16), ("b", 8))):
        out[f"dc{i}"] = (_spread(c, shift, 8, bound("min", name), bound("max", name)) - 0.5) / C0
    alpha = np.clip((c & np.uint32(255)) / 255, 1e-6, 1 - 1e-6)
    out["opacity_raw"] = np.log(alpha / (1 - alpha))
    three = np.stack([((r >> np.uint32(k)) & np.uint32(1023)) / 1023 - 0.5 for k in (20, 10, 0)]) * np.sqrt(2)
    largest = np.sqrt(np.maximum(0, 1 - (three**2).sum(0)))
    which = (r >> np.uint32(30)).astype(int)
    q = np.empty((4, len(rows)))
    for k in range(4):  # the others keep their order around the largest
        others = [i for i in range(4) if i != k]
        mine = which == k
        q[k, mine] = largest[mine]
        q[np.ix_(others, np.flatnonzero(mine))] = three[:, mine]
    return out | dict(zip(("qw", "qx", "qy", "qz"), _unit(q), strict=True))


def decode(data: bytes, harmonics: bool = True) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """(first row, columns, rest[rows, coefficients, 3]) in lots."""
    header = parse_header(data)
    if "vertex" not in header.elements:
        raise ValueError("the PLY file has no vertex element")
    n, layout = header.elements["vertex"]
    packed = "packed_position" in (layout.names or ())
    source = "sh" if packed else "vertex"
    chunks = None
    if packed:
        if "chunk" not in header.elements:
            raise ValueError("a compressed PLY file needs chunks")
        chunks = _rows(data, header, "chunk", 0, header.elements["chunk"][0])
    count = _rest_count(header.elements[source][1]) if harmonics and source in header.elements else 0
    count = count if count in _DEGREES else 0
    if count and header.elements[source][0] != n:
        raise ValueError("the numbers of rows of vertex and sh differ")
    for first in range(0, n, _ROWS):
        rows = _rows(data, header, "vertex", first, first + _ROWS)
        columns = _packed(rows, chunks, first) if packed else _plain(rows)
        rest = np.zeros((len(rows), count // 3, 3))
        if count:
            raw = _rows(data, header, source, first, first + _ROWS)
            flat = np.stack([raw[f"f_rest_{k}"].astype(np.float64) for k in range(count)], 1)
            if packed:  # bytes from -4 to 4, the ends exact
                flat = np.where(flat == 0, 0.0, np.where(flat == 255, 1.0, (flat + 0.5) / 256)) * 8 - 4
            rest = flat.reshape(len(rows), 3, count // 3).transpose(0, 2, 1)
        yield first, columns, rest


def read_raw(spark: SparkSession, path: str, harmonics: bool = True) -> DataFrame:
    """The raw table of all files at ``path`` (a file, folder or glob, in any store): a task for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for first, columns, rest in decode(content, harmonics):
                    n = len(rest)
                    arrays = [pa.array([name] * n), pa.array(np.arange(first, first + n)), *(pa.array(columns[c]) for c in _SCALARS[:6])]
                    arrays += [pa.array(rest.tolist(), pa.list_(pa.list_(pa.float64()))), *(pa.array(columns[c]) for c in _SCALARS[6:])]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "gid", *_SCALARS[:6], "rest", *_SCALARS[6:]])

    return files.mapInArrow(run, RAW_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The activated table of all files at ``path``."""
    return activate(read_raw(spark, path, harmonics=False)).drop("opacity_raw", "dc0", "dc1", "dc2", "rest")


def encode(columns: dict[str, np.ndarray], rest: np.ndarray) -> bytes:
    """A plain file of raw columns; ``rest`` is [rows, coefficients, 3] and is stored channel by channel."""
    n = len(rest)
    flat = rest.transpose(0, 2, 1).reshape(n, -1)
    names = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{i}" for i in range(flat.shape[1])), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]
    zeros = np.zeros(n)
    body = np.stack([*(columns[c] for c in ("px", "py", "pz")), zeros, zeros, zeros, *(columns[f"dc{i}"] for i in range(3)), *flat.T, *(columns[c] for c in ("opacity_raw", "sx", "sy", "sz", "qw", "qx", "qy", "qz"))], 1)
    header = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {c}" for c in names), "end_header", ""])
    return header.encode() + body.astype("<f4").tobytes()


def encoded(raw: DataFrame, rows_per_file: int = 1 << 20) -> DataFrame:
    """(part, content): plain files of up to ``rows_per_file`` rows each in gid order, made on the executors."""
    part = F.floor(F.col("gid") / rows_per_file).cast("long")

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("gid")
        width = max((len(r) for r in pdf["rest"]), default=0)
        rest = np.zeros((len(pdf), width, 3))
        for i, r in enumerate(pdf["rest"]):
            for k, channel in enumerate(r):
                rest[i, k] = channel
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "content": [encode({c: pdf[c].to_numpy(float) for c in _SCALARS}, rest)]})

    return raw.withColumn("part", part).select("part", "gid", "rest", *_SCALARS).groupBy("part").applyInPandas(build, "part long, content binary")


def write(df: DataFrame, path: str) -> None:
    """One plain file at a local ``path``, from a raw or an activated table."""
    raw = df if "opacity_raw" in df.columns else deactivate(df)
    parts = [r.content for r in encoded(raw, 1 << 62).collect()]
    with open(path, "wb") as f:
        f.write(parts[0] if parts else encode({c: np.zeros(0) for c in _SCALARS}, np.zeros((0, 0, 3))))
