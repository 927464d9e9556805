"""Imagery catalogs: queries with a year fallback, ranking, greedy cover, resolution and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import boxes
from fieldloom.operators.fields import in_bounds


def query(items: DataFrame, bounds, year: int, state: str | None = None, fallback: bool = True) -> DataFrame:
    """Items of category 1 (of a state) that meet the bounds, of the year or, only if there are none, of the years around it."""
    near = items.where((F.col("category") == 1) & F.col("box").isNotNull() & in_bounds(F.col("box"), bounds))
    if state is not None:
        near = near.where(F.upper("state") == state.upper())
    exact = near.where(F.col("year") == year)
    if not fallback:
        return exact
    around = near.where(F.col("year").between(year - 1, year + 1))
    some = exact.limit(1).agg((F.count("*") > 0).alias("__some"))  # one row
    return around.crossJoin(F.broadcast(some)).where(~F.col("__some") | (F.col("year") == year)).drop("__some")


def rank_keys(bounds, year: int) -> list[Column]:
    """The ranking's keys: category, distance of the year, bands, common area, resolution, date and id."""
    aoi = boxes.box(*bounds)
    return [
        (F.col("category") != 1).cast("int"), F.coalesce(F.abs(F.col("year") - year), F.lit(9999)), (F.col("band_count") < 4).cast("int"),
        -boxes.common_area(F.col("box"), aoi), F.coalesce("resolution_value", F.lit(float("inf"))), F.coalesce("acquisition_date", F.lit("")), F.col("object_id"),
    ]


def rank(items: DataFrame, bounds, year: int) -> DataFrame:
    """The items with ``rank`` from 1. The order is global, so this belongs after a query by bounds and year."""
    return items.withColumn("rank", F.row_number().over(Window.orderBy(*rank_keys(bounds, year))))


def greedy_cover(ranked: DataFrame, bounds, most: int, enough: float = 0.999) -> DataFrame:
    """Items in the order of their rank that each add area, until the bounds are covered or ``most`` are taken; if none adds any, the first.

    Cover is found on the grid of all items' edges, sequentially: one task, for the ranked result of a query."""
    x0, y0, x1, y1 = (float(v) for v in bounds)

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        d = pd.concat([*parts], ignore_index=True)
        if d.empty:
            return
        d = d.sort_values("rank", ignore_index=True)
        xs = np.unique(np.clip([x0, x1, *d.xmin, *d.xmax], x0, x1))
        ys = np.unique(np.clip([y0, y1, *d.ymin, *d.ymax], y0, y1))
        cell, covered = np.outer(np.diff(ys), np.diff(xs)), np.zeros((len(ys) - 1, len(xs) - 1), dtype=bool)
        total, taken, kept = cell.sum(), 0.0, []
        for row in d.itertuples():
            if len(kept) >= most or (total and taken >= enough * total):
                break
            part = np.outer((ys[:-1] >= row.ymin) & (ys[1:] <= row.ymax), (xs[:-1] >= row.xmin) & (xs[1:] <= row.xmax)) & ~covered
            gain = float(cell[part].sum())
            if gain > 0:
                kept.append((row.object_id, row.rank, gain))
                taken += gain
                covered |= part
        if not kept:
            kept = [(d.object_id[0], d["rank"][0], 0.0)]
        yield pd.DataFrame(kept, columns=["object_id", "rank", "gain"])

    narrow = ranked.select("object_id", "rank", *boxes.flat(F.col("box")))
    return narrow.coalesce(1).mapInPandas(choose, "object_id long, rank int, gain double")


def nearest_year(years: DataFrame, target: int) -> DataFrame:
    """The available year that is nearest, the earlier of two."""
    return years.agg(F.min_by("year", F.struct(F.abs(F.col("year") - target), F.col("year"))).alias("year"))


def resolution(items: DataFrame) -> DataFrame:
    """The least positive resolution, 1.0 without one."""
    v = F.col("resolution_value")
    return items.agg(F.coalesce(F.min(F.when(v > 0, v)), F.lit(1.0)).alias("resolution_m"))


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits of the sha1 of the parts, joined by '|'."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12)
