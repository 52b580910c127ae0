"""the residuals' grid opens within a frame's row, it isn't exchanged."""

import math

from vistaspark.operators import skyline


def test_residuals_exchange_no_row_for_each_shift(spark):
    ys = {(f, c): math.sin(f * 7 + c * c) for f in range(3) for c in range(64) if (f + c) % 7}
    profiles = spark.createDataFrame([(f, c, y) for (f, c), y in ys.items()], "frame long, col int, y double")
    rings = spark.createDataFrame([(f + 1, c, y) for (f, c), y in ys.items()], "frame long, ray int, angle double")
    shifts = spark.createDataFrame([(s, t) for s in range(-3, 4) for t in (-0.1, 0.2)], "shift int, tilt double")
    found = skyline.residuals(profiles, rings, 64, shifts)
    got = {(r["frame"], r["shift"], r["tilt"]): r["residual"] for r in found.collect()}
    wanted = {}
    for f in (1, 2):
        for s, t in {k[1:] for k in got}:
            e = sorted(abs(y + t - ys[f - 1, (c + s) % 64]) for (g, c), y in ys.items() if g == f and (f - 1, (c + s) % 64) in ys)
            wanted[f, s, t] = e[len(e) // 2]
    assert got == wanted and len(got) == 28
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("shift" not in line for line in plan.splitlines() if "Aggregate" in line)
