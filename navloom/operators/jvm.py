"""Routes.java on DataFrames: routes are searched in Spark's own processes, where a step of a search takes a tenth of Python's time or less.

The class is compiled in the driver by Janino, which Spark has for its generated code, and goes to the executors as a
jar: nothing needs to be installed there. A tile is one row, its polygons and links compressed columns of numbers.
"""

from __future__ import annotations

import atexit
import pkgutil
import shutil
import tempfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from navloom.functions import geometry as g
from navloom.operators import kernel
from navloom.operators.packed import LINKS, POLYS

#: the columns of the rows that Routes.java reads, in order; kind is 0 for tiles and 1 for pairs
COLUMNS = "map_id level bx by lot kind tx ty polys links sp sx sy sz gp gx gy gz x0 y0 x1 y1".split()
_made: dict[str, object] = {}


def pack_polys(rows: pa.Table) -> bytes:
    """Counts of polygons and corners, refs, flags, areas, types, corners by axis, and where each polygon's corners begin."""
    rows = rows.select(POLYS.names).cast(POLYS)
    corners = rows["corners"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(corners), 0).to_numpy(zero_copy_only=False)
    places = [v.to_numpy(zero_copy_only=False).astype("<f8") for v in corners.flatten().flatten()]
    first = np.zeros(len(size) + 1, "<i4")
    np.cumsum(size, out=first[1:])
    head = np.array([rows.num_rows, len(places[0])], "<i8")
    return zlib.compress(b"".join(v.tobytes() for v in (head, *(rows[c].fill_null(0).to_numpy().astype("<i8") for c in ("ref", "flags", "area", "ptype")), *places, first)), 1)


def pack_links(rows: pa.Table) -> bytes:
    """How many, sources, targets, and edge, side and both ends of the passage as bytes of one number; by source, edge and target, each once."""
    own = {c: v.to_numpy() for c, v in zip(LINKS.names, rows.select(LINKS.names).cast(LINKS).columns, strict=True)}
    by = np.lexsort([own[c] for c in ("bmax", "bmin", "side", "dst", "edge", "src")])
    own = {c: v[by] for c, v in own.items()}
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in own.values()])
    own = {c: v[fresh] for c, v in own.items()}
    link = np.zeros(len(own["src"]), np.int64)
    for c in ("edge", "side", "bmin", "bmax"):
        if np.any((own[c] < 0) | (own[c] > 255)):
            raise ValueError(f"{c} of a link is no byte")
        link = link << 8 | own[c]
    return zlib.compress(b"".join(v.tobytes() for v in (np.array([len(link)], "<i8"), own["src"].astype("<i8"), own["dst"].astype("<i8"), link.astype("<u4"))), 1)


def _new(spark: SparkSession):
    """A Routes without settings; the class is compiled and sent once for an application."""
    sc = spark.sparkContext
    kind = _made.get(sc.applicationId)
    if kind is None:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, "Routes.java").decode())
        folder = tempfile.mkdtemp(prefix="navloom-jar-")  # the driver serves it until it ends
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/navloom-routes.jar", "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(f"{folder}/navloom-routes.jar")
        kind = _made[sc.applicationId] = compiler.getClassLoader().loadClass("navloom.Routes")
    return kind.newInstance()


def search(rows: DataFrame, rules: kernel.Filter, result: str, waypoints: bool, most: int = 4096, most_nodes: int = 65535, most_expansions: int | None = None) -> DataFrame:
    """`result` for each row of a pair. rows: COLUMNS, all of a block in one partition, in order of block and kind."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    factors = sc._gateway.new_array(sc._jvm.double, len(rules.cost))
    for i, v in enumerate(rules.cost):
        factors[i] = float(v)
    own = getattr(_new(spark), "with")(rules.include, rules.exclude, factors, most, most_nodes, -1 if most_expansions is None else most_expansions, 4096, waypoints, g.HEURISTIC, g.SAME_POINT, 0.001**2)
    encoder = sc._jvm.org.apache.spark.sql.Encoders.row(sc._jvm.org.apache.spark.sql.types.StructType.fromDDL(result))
    return DataFrame(rows.select(*COLUMNS)._jdf.mapPartitions(own, encoder), spark)
