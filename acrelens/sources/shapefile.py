"""Polygon shapefiles as a Spark data source, and their writing by tasks.

A shapefile is three files: records of polygons (.shp), the place and length of each
record (.shx) and rows of attributes of one width (.dbf). The index tells how many records
there are without reading any, so partitions are ranges of records; a task reads the bytes
of its range from each file and nothing else, and makes Arrow batches from arrays of
coordinates. Paths may be on any file system that Arrow opens (a shared mount, HDFS, an
object store). The projection file (.prj) is text; see ``functions.projection``.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from acrelens.functions.projection import Projection, projection_of, projection_text, to_degrees

#: Records of a partition, and of a batch within it.
RECORDS = 100_000
BATCH = 4_096
POINT = "struct<x:double,y:double>"
PARTS = f"array<struct<ring:array<{POINT}>,holes:array<array<{POINT}>>>>"
# Kinds of shape that are polygons (plain, with heights, with measures), and the kind without geometry.
POLYGONS, NOTHING = (5, 15, 25), 0
_HEAD = 100
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_RING = pa.list_(_POINT)
_PARTS = pa.list_(pa.struct([("ring", _RING), ("holes", pa.list_(_RING))]))


class Attribute(NamedTuple):
    """A column of the attribute file."""

    name: str
    kind: str
    width: int
    decimals: int

    @property
    def spark(self) -> str:
        if self.kind in "NF":
            return "bigint" if self.kind == "N" and self.decimals == 0 and self.width <= 18 else "double"
        return {"D": "date", "L": "boolean"}.get(self.kind, "string")

    def values(self, cells: np.ndarray) -> list:
        """Values of fixed-width cells."""
        texts = [c.strip(b" \0") for c in cells.tolist()]
        if self.kind in "NF":
            whole = self.spark == "bigint"
            return [None if not t or t.startswith(b"*") else int(float(t)) if whole and b"." in t else int(t) if whole else float(t) for t in texts]
        if self.kind == "D":
            return [dt.date(int(t[:4]), int(t[4:6]), int(t[6:8])) if len(t) == 8 and t.isdigit() and t > b"00000000" else None for t in texts]
        if self.kind == "L":
            return [True if t in (b"T", b"t", b"Y", b"y") else False if t in (b"F", b"f", b"N", b"n") else None for t in texts]
        return [t.decode("utf-8", "replace") or None for t in texts]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _bytes(files: pafs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with files.open_input_file(path) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def _named(files: pafs.FileSystem, path: str) -> list[str]:
    """The shapefiles of a folder, or the one that is named, without their ending."""
    if path.endswith(".shp"):
        return [path[:-4]]
    return sorted(i.path[:-4] for i in files.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".shp"))


def _columns(files: pafs.FileSystem, stem: str) -> tuple[list[Attribute], int, int]:
    """The attribute file's columns, where its rows begin and how wide they are."""
    start, width = struct.unpack_from("<HH", _bytes(files, stem + ".dbf", 0, 32), 8)
    head = _bytes(files, stem + ".dbf", 0, start)
    columns, at = [], 32
    while at + 32 <= start and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("utf-8", "replace")
        columns.append(Attribute(name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return columns, start, width


class _Range(InputPartition):
    def __init__(self, stem: str, first: int, last: int):
        self.stem, self.first, self.last = stem, first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.records, self.names = options["path"], int(options.get("records", RECORDS)), schema.names

    def partitions(self) -> list[InputPartition]:
        files, path = _opened(self.path)
        out = []
        for stem in _named(files, path):
            n = (files.get_file_info(stem + ".shx").size - _HEAD) // 8
            out += [_Range(stem, at, min(at + self.records, n)) for at in range(0, n, self.records)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        files, _ = _opened(self.path)
        stem = partition.stem
        columns, start, width = _columns(files, stem)
        with files.open_input_file(stem + ".shp") as shapes, files.open_input_file(stem + ".dbf") as rows, files.open_input_file(stem + ".shx") as index:
            for first in range(partition.first, partition.last, BATCH):
                last = min(first + BATCH, partition.last)
                places = np.frombuffer(index.read_at(8 * (last - first), _HEAD + 8 * first), dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
                low, high = int(places[:, 0].min()), int((places[:, 0] + places[:, 1]).max()) + 8
                geometry = polygons(shapes.read_at(high - low, low), (places[:, 0] - low).tolist())
                table = np.frombuffer(rows.read_at(width * (last - first), start + width * first), dtype=np.uint8).reshape(-1, width)
                out, at = {"file": pa.array([stem.rsplit("/", 1)[-1]] * (last - first)), "record": pa.array(np.arange(first + 1, last + 1)), "parts": geometry}, 1
                for c in columns:
                    cells = np.ascontiguousarray(table[:, at : at + c.width]).view(f"S{c.width}").ravel()
                    out[c.name] = pa.array(c.values(cells), {"bigint": pa.int64(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}.get(c.spark, pa.string()))
                    at += c.width
                missing = pa.nulls(last - first, pa.string())
                yield pa.RecordBatch.from_arrays([out.get(n, missing) for n in self.names], self.names)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    crossed = (y1 > y) != (y2 > y)
    return bool(np.count_nonzero(x < (x2[crossed] - x1[crossed]) * (y - y1[crossed]) / (y2[crossed] - y1[crossed]) + x1[crossed]) % 2)


def _turn(ring: np.ndarray) -> float:
    """Twice a closed ring's area, negative if it runs clockwise."""
    near = ring - ring[0]
    return float((near[:-1, 0] * near[1:, 1] - near[1:, 0] * near[:-1, 1]).sum())


def polygons(data: bytes, places: list[int]) -> pa.Array:
    """The polygons of records as parts: outer rings (clockwise in the file) with the holes that they hold; null without geometry.

    Rings come without their closing point. A hole that no outer ring holds is the first one's.
    """
    outer, holes, hole_rings = [], [], []  # rings in order, per part its number of holes, the holes' rings
    parts: list[int | None] = []
    for at in places:
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind not in POLYGONS:
            if kind != NOTHING:
                raise ValueError(f"no polygon but a shape of kind {kind}")
            parts.append(None)
            continue
        n_rings, n_points = struct.unpack_from("<ii", data, at + 44)
        starts = np.frombuffer(data, dtype="<i4", count=n_rings, offset=at + 52).tolist()
        points = np.frombuffer(data, dtype="<f8", count=2 * n_points, offset=at + 52 + 4 * n_rings).reshape(-1, 2)
        rings = [points[a:b] for a, b in zip(starts, [*starts[1:], n_points])]
        turns = [_turn(r) for r in rings]
        shells = [r for r, t in zip(rings, turns) if t <= 0] or rings[:1]
        inner = [r for r, t in zip(rings, turns) if t > 0] if len(shells) < len(rings) else []
        inner = [r for r in inner if r is not shells[0]]
        own: list[list[np.ndarray]] = [[] for _ in shells]
        for hole in inner:
            held = [i for i, shell in enumerate(shells) if len(shells) == 1 or _holds(shell, *hole[0])]
            own[min(held, key=lambda i: abs(_turn(shells[i])), default=0)].append(hole)
        parts.append(len(shells))
        outer += shells
        for some in own:
            holes.append(len(some))
            hole_rings += some
    sums = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32))

    def lists(rings: list[np.ndarray]) -> pa.ListArray:
        opened = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
        flat = np.concatenate(opened) if opened else np.zeros((0, 2))
        return pa.ListArray.from_arrays(sums([len(r) for r in opened]), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], fields=list(_POINT)))

    shells_held = pa.StructArray.from_arrays([lists(outer), pa.ListArray.from_arrays(sums(holes), lists(hole_rings))], fields=list(_PARTS.value_type))
    return pa.ListArray.from_arrays(sums([n or 0 for n in parts]), shells_held, mask=pa.array([n is None for n in parts]))


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load(path)``: file, record, parts and the attributes of a shapefile or a folder of them.

    Options: ``records``, how many a partition has. All files of a folder have the columns of the first.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        files, path = _opened(self.options["path"])
        stems = _named(files, path)
        columns = _columns(files, stems[0])[0] if stems else []
        return ", ".join([f"file string, record bigint, parts {PARTS}", *[f"`{c.name}` {c.spark}" for c in columns]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapefileReader(schema, self.options)


def read_shapefile(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """file, record, parts (in the plane) and attributes of a shapefile or of all in a folder."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("records", records).load(path)


def plane_of(path: str, expected: Projection) -> tuple[Projection, str | None]:
    """The plane that the first projection file tells, else the expected one; and what to warn of."""
    files, at = _opened(path)
    for stem in _named(files, at)[:1]:
        if files.get_file_info(stem + ".prj").type != pafs.FileType.NotFound:
            found = projection_of(_bytes(files, stem + ".prj").decode("utf-8", "replace"))
            return found, None if found == expected else f"{path} is in another plane than expected"
    return expected, f"{path} names no plane; the expected one is taken"


def centroid(parts: Column) -> Column:
    """Area-weighted centroid of parts with holes as struct<x,y>; null for null geometry.

    Sums run relative to the first corner, as coordinates of a plane are large against a parcel.
    """
    origin = parts[0]["ring"][0]

    def sums(ring: Column, sign: float) -> Column:
        n = F.size(ring)

        def side(i: Column) -> Column:
            p, q = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % n + 1).cast("int"))
            px, py, qx, qy = p["x"] - origin["x"], p["y"] - origin["y"], q["x"] - origin["x"], q["y"] - origin["y"]
            cross = px * qy - qx * py
            return F.struct(cross.alias("w"), ((px + qx) * cross).alias("x"), ((py + qy) * cross).alias("y"))

        sides = F.transform(F.sequence(F.lit(1), n), side)
        total = F.aggregate(sides, _triple(0.0, 0.0, 0.0), lambda a, s: _triple(a["w"] + s["w"], a["x"] + s["x"], a["y"] + s["y"]))
        way = lambda t: F.when(t["w"] < 0, -sign).otherwise(sign)
        return _once(total, lambda t: _triple(t["w"] * way(t), t["x"] * way(t), t["y"] * way(t)))

    rings = F.flatten(F.transform(parts, lambda p: F.concat(F.array(sums(p["ring"], 1.0)), F.transform(p["holes"], lambda h: sums(h, -1.0)))))
    whole = F.aggregate(rings, _triple(0.0, 0.0, 0.0), lambda a, s: _triple(a["w"] + s["w"], a["x"] + s["x"], a["y"] + s["y"]))
    place = _once(whole, lambda t: F.struct((origin["x"] + F.try_divide(t["x"], 3 * t["w"])).alias("x"), (origin["y"] + F.try_divide(t["y"], 3 * t["w"])).alias("y")))
    return F.when(F.size(parts) > 0, place)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _triple(w, x, y) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, float) else v
    return F.struct(lit(w).alias("w"), lit(x).alias("x"), lit(y).alias("y"))


def parcel_places(shapes: DataFrame, plane: Projection) -> DataFrame:
    """``shapes`` with lon and lat of the centroid, which is taken in the plane before; rows without geometry are left out."""
    # Exploding one row keeps the formulas of the plane from repeating the centroid.
    at = shapes.filter("parts is not null").withColumn("_at", F.explode(F.array(centroid(F.col("parts")))))
    lon, lat = to_degrees(plane, F.col("_at.x"), F.col("_at.y"))
    return at.withColumns({"lon": lon, "lat": lat}).drop("_at")


# Writing.


def _record(parts: list | None) -> tuple[bytes, tuple[float, ...] | None]:
    """The bytes of a polygon, and its box."""
    if parts is None:
        return struct.pack("<i", NOTHING), None
    rings = []
    for part in parts:
        for ring, wanted in [(part["ring"], -1), *[(h, 1) for h in part["holes"] or []]]:
            points = np.array([(p["x"], p["y"]) for p in ring])
            points = np.vstack([points, points[:1]])
            rings.append(points if _turn(points) * wanted >= 0 else points[::-1])
    flat = np.concatenate(rings)
    starts = np.cumsum([0, *[len(r) for r in rings[:-1]]]).astype("<i4")
    box = (*flat.min(axis=0).tolist(), *flat.max(axis=0).tolist())
    return struct.pack("<i4dii", POLYGONS[0], *box, len(rings), len(flat)) + starts.tobytes() + flat.astype("<f8").tobytes(), box


def _file_head(kind: int, size: int, box: tuple[float, ...]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii4d4d", 1000, kind, *box, 0, 0, 0, 0)


def write_shapefile(rows: DataFrame, folder: str, plane: Projection | None = None) -> list[str]:
    """Write rows (``parts`` and attributes: text of up to 254 bytes, whole numbers, doubles) as one shapefile per task that has any.

    Names tell the partition and the attempt; those of attempts that failed are removed at the
    end. Returns the names written.
    """
    columns = []
    for f in rows.schema.fields:
        if f.name != "parts":
            kind = f.dataType.simpleString()
            columns.append(Attribute(f.name, *{"string": ("C", 254, 0), "double": ("F", 24, 15)}.get(kind, ("N", 18, 0))))
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, 0, 33 + 32 * len(columns), 1 + sum(c.width for c in columns))
    fields = b"".join(c.name.encode()[:10].ljust(11, b"\0") + c.kind.encode() + bytes(4) + bytes([c.width, c.decimals]) + bytes(14) for c in columns)

    def cell(c: Attribute, value) -> bytes:
        if c.kind == "C":
            return ("" if value is None else value).encode()[: c.width].ljust(c.width)
        text = "" if value is None else str(value) if c.kind == "N" else f"{value:.15e}"
        return text.encode().rjust(c.width)[: c.width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = _opened(folder)
        stem = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        index, n, at, boxes, shapes, table = [], 0, _HEAD, [], None, None
        parted = lambda: (files.open_output_stream(stem + ".records"), files.open_output_stream(stem + ".rows"))
        for batch in batches:
            if batch.num_rows and shapes is None:
                files.create_dir(root, recursive=True)
                shapes, table = parted()
            for row in batch.to_pylist():
                n += 1
                body, box = _record(row["parts"])
                boxes += [box] if box else []
                shapes.write(struct.pack(">ii", n, len(body) // 2) + body)
                index.append(struct.pack(">ii", at // 2, len(body) // 2))
                at += 8 + len(body)
                table.write(b" " + b"".join(cell(c, row[c.name]) for c in columns))
        if n:
            shapes.close()
            table.close()
            ends = np.array(boxes) if boxes else np.zeros((1, 4))
            box = (*ends[:, :2].min(axis=0).tolist(), *ends[:, 2:].max(axis=0).tolist())
            whole = head[:4] + struct.pack("<I", n) + head[8:] + fields + b"\r"
            for end, first, body in ((".shp", _file_head(POLYGONS[0], at, box), stem + ".records"), (".dbf", whole, stem + ".rows")):
                with files.open_output_stream(stem + end) as out, files.open_input_stream(body) as held:  # heads tell sizes, so they come last
                    out.write(first)
                    while block := held.read(1 << 20):
                        out.write(block)
                files.delete_file(body)
            with files.open_output_stream(stem + ".shx") as out:
                out.write(_file_head(POLYGONS[0], _HEAD + 8 * n, box) + b"".join(index))
            if plane is not None:
                with files.open_output_stream(stem + ".prj") as out:
                    out.write(projection_text(plane).encode())
            yield pa.RecordBatch.from_pydict({"name": [stem.rsplit("/", 1)[-1]]})

    names = [r["name"] for r in rows.mapInArrow(run, "name string").collect()]  # a row per task
    files, root = _opened(folder)
    if names:
        for info in files.get_file_info(pafs.FileSelector(root)):
            if info.base_name.rsplit(".", 1)[0] not in names:
                files.delete_file(info.path)
    return sorted(names)

