"""Distance and way between two world points, from files: python -m navloom FOLDER MAP X1 Y1 X2 Y2 [--path].

Prints the length with four decimals, -1.0000 where there is no way, and with --path its waypoints.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.operators import mesh
from navloom.operators.routes import routes
from navloom.operators.terrain import heights
from navloom.operators.tiles import cover
from navloom.session import ready
from navloom.sources import binary


def find(spark: SparkSession, folder: str, map_id: int, x1: float, y1: float, x2: float, y2: float, padding: int = 0) -> tuple[float, list[tuple[float, float]]]:
    """(length or -1, waypoints as world x and y) over the mesh and terrain files below a folder."""
    ready(spark)
    if max(map(abs, (x1, y1, x2, y2))) > g.WORLD_BOUND:
        return g.NO_PATH, []
    pair = spark.createDataFrame([(0, x1, y1, x2, y2)], "pair_id long, x1 double, y1 double, x2 double, y2 double")
    tiles = [(r["tx"], r["ty"]) for r in cover(pair, padding).collect()]  # one pair's rectangle, at most the whole grid
    if not tiles:
        return g.NO_PATH, []
    names = lambda end: "{" + ",".join(f"{map_id:03d}{x:02d}{y:02d}{end}" for x, y in tiles) + "}"  # noqa: E731  only the covered files are read
    ends = spark.createDataFrame([(0, x1, y1), (1, x2, y2)], "event_id long, wx double, wy double")
    z = {r["event_id"]: r["height"] for r in heights(ends, binary.terrain(spark, folder, names(".map"))).collect()}
    if z[0] is None or z[1] is None:
        return g.NO_PATH, []
    polys = binary.polygons(spark, folder, names(".mmtile")).withColumn("tile", F.struct("x", "y", "layer", "pid")).checkpoint()
    number = polys.select("tile").distinct().select("tile", (F.row_number().over(Window.orderBy("tile")) - 1).cast("long").alias("ref")).checkpoint()  # the tiles of one rectangle
    polys = polys.join(number, "tile").withColumn("idx", F.col("pid")).drop("tile", "pid")
    climb = polys.agg(F.max("climb")).first()[0] or 0.0
    at = spark.createDataFrame([(i, y, float(z[i]), x) for i, (x, y) in enumerate(((x1, y1), (x2, y2)))], "event_id long, px double, py double, pz double")
    near = {r["event_id"]: r for r in mesh.nearest_polygon(at, polys.where("flags <> 0"), g.SNAP, climb, cell=g.TILE / 16).collect()}
    if len(near) < 2:
        return g.NO_PATH, []
    ends = [v for i in (0, 1) for v in (near[i]["ref"], near[i]["x"], near[i]["y"], near[i]["z"])]
    pairs = spark.createDataFrame([(0, *ends)], "pair_id long, sp long, sx double, sy double, sz double, gp long, gx double, gy double, gz double")
    (found,) = routes(pairs, polys.drop("map_id"), mesh.all_links(polys.drop("map_id"))).collect()
    return found["distance"], [(w["z"], w["x"]) for w in found["waypoints"] or ()]


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("map_id", type=int)
    parser.add_argument("ends", type=float, nargs=4, metavar=("X1", "Y1", "X2", "Y2"))
    parser.add_argument("--path", action="store_true")
    parser.add_argument("--padding", type=int, default=0)
    args = parser.parse_args()
    d, way = find(SparkSession.builder.getOrCreate(), args.folder, args.map_id, *args.ends, padding=args.padding)
    print(f"{d:.4f}")
    if args.path:
        print("\n".join(f"{x:.4f} {y:.4f}" for x, y in way))


if __name__ == "__main__":
    main()
