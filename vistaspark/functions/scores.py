"""Ranking scores of peaks and search hits (survey M1-M4)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def isolation_weight(iso_m: Column) -> Column:
    """M1: 0.55 up to 300 m, 1 from 30 km, logarithmic between; unknown is 1."""
    share = F.log(F.greatest(iso_m, F.lit(1.0)) / 300.0) / math.log(100.0)
    return F.when(iso_m.isNull(), 1.0).otherwise(0.55 + 0.45 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def label_score(ele: Column, d: Column, iso_m: Column) -> Column:
    """M2: height, nearness within tens of kilometres, and isolation."""
    return F.coalesce(ele, F.lit(0)) * (1 + 0.4 * F.exp(-d / 40000.0)) * isolation_weight(iso_m)


def index_score(ele: Column, iso_m: Column, known: Column) -> Column:
    """M3: as above without an observer; what an encyclopedia knows counts for more."""
    return F.coalesce(ele, F.lit(0)) * isolation_weight(iso_m) * F.when(known, 1.35).otherwise(1.0)


def hit_score(ele: Column, exact: Column, typos: Column, km: Column) -> Column:
    """M4: exact hits count double, each typo halves, near ones gain up to half."""
    return F.coalesce(ele, F.lit(0)) * F.when(exact, 2.0).otherwise(1.0) / F.pow(F.lit(2.0), typos) * (1 + 0.5 * F.exp(-km / 500.0))
