"""Gaps between stones of any shape: a join by bounding circles, then outlines against outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions import shapes
from lapidary.operators.spatial import close_pairs

COLUMNS = ["shape", "w_mm", "h_mm", "rot_deg"]
AT_ONCE = 512  # pairs of 64 x 64 edges and points


def edge_gaps(pairs: DataFrame) -> DataFrame:
    """Adds ``gap`` to pairs of stones (a_ and b_: shape, x_mm, y_mm, w_mm, h_mm, rot_deg, phys_mm).

    Between two round stones it is exact; any other pair is measured on outlines of 64 points, of 32 for a round one. A shape
    without an outline of its own counts as the ellipse of its box. Negative where stones overlap.
    """
    both = (F.col("a_shape") == "round") & (F.col("b_shape") == "round")
    exact = F.when(both, F.col("distance") - (F.col("a_phys_mm") + F.col("b_phys_mm")) / 2)
    rows = pairs.withColumn("gap", exact)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            gap = column("gap").astype(float)
            todo = np.flatnonzero(batch.column("gap").is_null().to_numpy(zero_copy_only=False))
            side = lambda s, at: shapes.outlines(
                column(f"{s}_shape")[at], column(f"{s}_x_mm")[at], column(f"{s}_y_mm")[at],
                *(np.where(column(f"{s}_shape")[at] == "round", column(f"{s}_phys_mm")[at], column(f"{s}_{c}_mm")[at]) for c in "wh"), column(f"{s}_rot_deg")[at],  # noqa: B023
            )
            for k in range(0, len(todo), AT_ONCE):
                at = todo[k : k + AT_ONCE]
                gap[at] = shapes.gaps(side("a", at), side("b", at))
            yield batch.set_column(names.index("gap"), "gap", pa.array(gap))

    return rows.mapInArrow(run, rows.schema)


def shaped_pairs(stones: DataFrame, clearance: float, keys: list[str]) -> DataFrame:
    """Unordered pairs whose outlines are less than ``clearance`` apart, with their gap.

    Also w_mm, h_mm (the box before it is turned, the long side upright), rot_deg and shape of each stone.
    """
    # no outline leaves its box
    bound = F.when(F.col("shape") == "round", F.col("phys_mm")).otherwise(F.hypot("w_mm", "h_mm"))
    rows = stones.select(*keys, "stone_id", "x_mm", "y_mm", "phys_mm", *COLUMNS).withColumn("_bound", bound)
    return edge_gaps(close_pairs(rows, clearance, keys, size="_bound").drop("a__bound", "b__bound")).where(F.col("gap") < clearance)
