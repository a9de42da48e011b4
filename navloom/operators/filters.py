"""Route filters: which polygons may be walked, and at what cost."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from navloom.functions import geometry as g


@dataclass(frozen=True)
class RouteFilter:
    """Flags to include and exclude, and cost factors by area (1 where none is given).

    `predicate` may add a condition on the polygon's columns; it is evaluated when links are built.
    Cost factors below 1 make the search's estimate inadmissible, as everywhere.
    """

    include: int = 0xFFFF
    exclude: int = 0
    area_cost: dict[int, float] = field(default_factory=dict)
    predicate: Column | None = None

    def passes(self, flags="flags") -> Column:
        own = g.passes(flags, self.include, self.exclude)
        return own if self.predicate is None else own & self.predicate

    def cost(self, area="area") -> Column:
        if not self.area_cost:
            return F.lit(1.0)
        table = F.create_map(*(F.lit(x) for k, v in sorted(self.area_cost.items()) for x in (k, float(v))))
        return F.coalesce(F.try_element_at(table, g.col(area).cast("int")), F.lit(1.0))

    def costs(self) -> list[float]:
        return [float(self.area_cost.get(i, 1.0)) for i in range(64)]
