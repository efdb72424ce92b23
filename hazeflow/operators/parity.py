"""Do training, serving and recomputation see the same features?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null
from ..schema import KEY_COLS


def parity_report(
    reference: DataFrame, views: dict[str, DataFrame], cols: list[str], tolerance: float = 0.0, keys: list[str] = KEY_COLS
) -> DataFrame:
    """(view, column, n_shared, n_missing, n_extra, n_differs, max_abs_diff): each view held against the reference, key by key.

    A key of the reference that a view lacks is missing there, one of the view's own is extra. On shared keys a value differs if
    one side is unknown and the other is not, or if they are further apart than ``tolerance``; the largest difference is
    over known values, NULL where there are none. Views have one row per key; rows with a null in the key count as the key they are. Without views: no rows.

    All views meet in one aggregate by key, which combines before the shuffle; the second one has a row per view.
    """
    sides = {"": reference, **views}
    tagged = [
        df.select(*keys, F.lit(name).alias("_view"), F.struct(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).alias("_row"))
        for name, df in sides.items()
    ]
    marks = {name: f"_v{i}" for i, name in enumerate(sides)}
    by_key = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_view") == name, F.col("_row"))).alias(mark) for name, mark in marks.items()]
    )
    base = F.col(marks[""])
    pairs = [F.struct(F.lit(name).alias("view"), F.col(marks[name]).alias("row")) for name in views]
    if not pairs:
        return reference.sparkSession.createDataFrame(
            [], "view string, column string, n_shared long, n_missing long, n_extra long, n_differs long, max_abs_diff double"
        )
    held = by_key.select(base.alias("base"), F.explode(F.array(*pairs)).alias("p")).select("base", "p.view", "p.row")
    shared = F.col("base").isNotNull() & F.col("row").isNotNull()
    apart = {c: F.abs(F.col(f"row.{c}") - F.col(f"base.{c}")) for c in cols}
    # Equal infinities are no distance apart.
    differs = {
        c: shared & ~F.col(f"row.{c}").eqNullSafe(F.col(f"base.{c}")) & F.coalesce(apart[c] > F.lit(tolerance), F.lit(True)) for c in cols
    }
    counted = held.groupBy("view").agg(
        F.count_if(shared).alias("n_shared"),
        F.count_if(F.col("base").isNotNull() & F.col("row").isNull()).alias("n_missing"),
        F.count_if(F.col("base").isNull() & F.col("row").isNotNull()).alias("n_extra"),
        *[F.count_if(differs[c]).alias(f"_n_{c}") for c in cols],
        *[F.max(F.when(shared, nan_to_null(apart[c]))).alias(f"_max_{c}") for c in cols],
    )
    per_column = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("n_differs"), F.col(f"_max_{c}").alias("max_abs_diff")) for c in cols])
    )
    return counted.select("view", "n_shared", "n_missing", "n_extra", per_column.alias("c")).select(
        "view", "c.column", "n_shared", "n_missing", "n_extra", "c.n_differs", "c.max_abs_diff"
    )
