"""One ranking from several differently-scaled scores, by outranking net flow.

Per score every item is compared with every other of its group by how far their
percentiles lie apart; the comparisons are summed exactly through sorted prefix
sums, never pair by pair, and the weighted sums of all scores give the ranking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.operators.prefix import running_sums

#: Percentile distances up to the first do not matter, from the second on they count full.
INDIFFERENT, FULL = 0.05, 0.5
#: Decimals of a flow; flows equal to these are ties.
DECIMALS = 6


def net_flows(df: DataFrame, group: str, item: str, scores: dict[str, float], block_rows: int = 1_000_000) -> DataFrame:
    """``group``, ``item``, ``flow`` and ``place`` (1 is best) of every item.

    ``scores`` gives the columns (higher is better) and their weights, which are
    scaled to sum to one.  The percentile of a value is the share of the group's
    values below it plus half of those equal; the preference of one item over
    another grows from 0 at a distance of ``INDIFFERENT`` to 1 at ``FULL``.  The flow
    on a score is the mean preference over all others minus the mean of theirs, in
    [-1, 1]; a null or NaN score has flow 0 and takes no part in the others' flows.
    Ties in flow go to the smaller item by code points.  Items must be unique within
    a group; rows with a null group or item are left out.  Groups of any size are
    summed in blocks.
    """
    total = sum(scores.values())
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    long = rows.select(
        F.col(group).alias("_q"),
        F.col(item).alias("_i"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("s"), F.lit(w / total).alias("w"), F.col(n).cast("double").alias("v"))
                    for n, w in scores.items()
                ]
            )
        ).alias("_s"),
    ).select("_q", "_i", "_s.s", "_s.w", F.when(~F.isnan("_s.v"), F.col("_s.v") + 0.0).alias("v"))
    long = long.withColumn("g", F.concat_ws("\x01", "s", "_q"))
    values = long.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sizes = values.groupBy("g").agg(F.sum("c").alias("n"))
    placed = running_sums(values, "g", "v", "v", {"c": "upto"}, block_rows).join(sizes, "g")
    # Twice the rank position, from 1 to 2n - 1; distances are measured in the same unit.
    placed = placed.select("g", "v", "c", "n", (2 * F.col("upto") - F.col("c")).alias("x"))
    near, far = 2 * INDIFFERENT * F.col("n"), 2 * FULL * F.col("n")
    bounds = [F.col("x") - far, F.col("x") - near, F.col("x") + near, F.col("x") + far]
    zero = F.lit(0.0)
    data = placed.select(
        "g", F.col("x").alias("at"), F.lit(0).alias("kind"), "c", (F.col("c") * F.col("x")).alias("cx"), "v"
    )
    asked = placed.select(
        "g",
        F.posexplode(F.array(*bounds)).alias("k", "at"),
        "v",
    ).select("g", "at", (F.col("k") + 1).alias("kind"), zero.alias("c"), zero.alias("cx"), "v")
    summed = running_sums(data.unionByName(asked), "g", "at", "kind", {"c": "sc", "cx": "sx"}, block_rows)
    picked = [
        F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("sc", "sx")
    ]
    at_value = summed.where("kind > 0").groupBy("g", "v").agg(*picked)
    near_by = placed.join(at_value, ["g", "v"])
    width = far - near
    over = F.col("sc1") + ((F.col("x") - near) * (F.col("sc2") - F.col("sc1")) - (F.col("sx2") - F.col("sx1"))) / width
    under = (
        F.col("n")
        - F.col("sc4")
        + ((F.col("sx4") - F.col("sx3")) - (F.col("x") + near) * (F.col("sc4") - F.col("sc3"))) / width
    )
    flow = F.when(F.col("n") > 1, (over - under) / (F.col("n") - 1)).otherwise(0.0)
    flows = near_by.select(F.col("g").alias("_g"), F.col("v").alias("_v"), flow.alias("f"))
    each = long.join(flows, (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v")), "left")
    combined = each.groupBy("_q", "_i").agg(
        F.round(F.sum(F.col("w") * F.coalesce("f", F.lit(0.0))) + 1e-12, DECIMALS).alias("flow")
    )
    ordered = combined.withColumns({"down": -F.col("flow"), "one": F.lit(1)})
    ranked = running_sums(ordered, "_q", "down", "_i", {"one": "place"}, block_rows)
    return ranked.select(
        F.col("_q").alias(group), F.col("_i").alias(item), "flow", F.col("place").cast("bigint").alias("place")
    )


def brute_flows(values: list[float | None]) -> list[float]:
    """The flow of every value by comparing all pairs; what the sums are tested against."""
    known = [v for v in values if v is not None and v == v]
    n = len(known)

    def percentile(v: float) -> float:
        return (sum(u < v for u in known) + sum(u == v for u in known) / 2) / n

    def preference(d: float) -> float:
        return min(1.0, max(0.0, (d - INDIFFERENT) / (FULL - INDIFFERENT)))

    out = []
    for v in values:
        if v is None or v != v or n < 2:
            out.append(0.0)
            continue
        d = [percentile(v) - percentile(u) for u in known]
        out.append(reduce(lambda s, x: s + preference(x) - preference(-x), d, 0.0) / (n - 1))
    return out
