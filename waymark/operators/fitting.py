"""Least-squares plan alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affine_fit(corr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Affine x, y, z -> u, v per group as a00..a03, a10..a13, from one aggregation.

    Centred second moments leave a 3x3 symmetric system that is solved in closed form.
    Groups with fewer than four rows or with flat points give nulls.
    """
    axes, plan = ("x", "y", "z"), ("u", "v")
    aggs = [F.count("*").alias("n")] + [F.avg(a).alias(f"m{a}") for a in (*axes, *plan)]
    aggs += [F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    aggs += [F.covar_pop(a, p).alias(f"c{a}{p}") for a in axes for p in plan]
    s = corr.groupBy(*keys).agg(*aggs)
    c = F.col
    # Cofactors of the symmetric matrix.
    k = {
        "xx": c("cyy") * c("czz") - c("cyz") * c("cyz"), "xy": c("cxz") * c("cyz") - c("cxy") * c("czz"),
        "xz": c("cxy") * c("cyz") - c("cxz") * c("cyy"), "yy": c("cxx") * c("czz") - c("cxz") * c("cxz"),
        "yz": c("cxy") * c("cxz") - c("cxx") * c("cyz"), "zz": c("cxx") * c("cyy") - c("cxy") * c("cxy"),
    }
    s = s.select("*", *[v.alias(f"k{n}") for n, v in k.items()])
    det = c("cxx") * c("kxx") + c("cxy") * c("kxy") + c("cxz") * c("kxz")
    s = s.withColumn("det", F.when((c("n") >= 4) & (F.abs(det) > 1e-12), det))
    out = []
    for i, p in enumerate(plan):
        row = [
            (c(f"k{min(a, b)}{max(a, b)}"), c(f"c{b}{p}")) for a in axes for b in axes
        ]
        coef = [sum((x * y for x, y in row[3 * r + 1 : 3 * r + 3]), row[3 * r][0] * row[3 * r][1]) / c("det") for r in range(3)]
        shift = c(f"m{p}") - (coef[0] * c("mx") + coef[1] * c("my") + coef[2] * c("mz"))
        out += [v.alias(f"a{i}{j}") for j, v in enumerate((*coef, shift))]
    return s.select(*keys, "n", *out)


def residuals(corr: DataFrame, fit: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Distance between the projected and the marked plan position, in metres of ``scale`` per pixel."""
    c = F.col
    rows = corr.join(fit, list(keys))
    pu = c("a00") * c("x") + c("a01") * c("y") + c("a02") * c("z") + c("a03")
    pv = c("a10") * c("x") + c("a11") * c("y") + c("a12") * c("z") + c("a13")
    return rows.withColumn("residual", F.sqrt((pu - c("u")) * (pu - c("u")) + (pv - c("v")) * (pv - c("v"))) * scale)
