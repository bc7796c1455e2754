"""Array helpers on single paths and on batches of path pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from fairlead.functions.geo import EARTH_RADIUS_M

RUN_POINTS = 1_000_000  # points of paths that are simplified together


def distance(lat1, lon1, lat2, lon2):
    """Great-circle metres, elementwise on degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    h = np.minimum(h, 1.0)
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def course(lat1, lon1, lat2, lon2):
    """Initial bearing in radians."""
    p1, p2, turn = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return np.arctan2(np.sin(turn) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(turn))


def offset(lat, lon, first, last):
    """Absolute cross-track metres of the points between two positions of a path."""
    inner = slice(first + 1, last)
    arc = distance(lat[first], lon[first], lat[inner], lon[inner]) / EARTH_RADIUS_M
    turn = course(lat[first], lon[first], lat[last], lon[last]) - course(lat[first], lon[first], lat[inner], lon[inner])
    return np.abs(np.arcsin(np.sin(arc) * np.sin(turn))) * EARTH_RADIUS_M


def kept_points(lat: np.ndarray, lon: np.ndarray, epsilon: float) -> list[int]:
    """Positions a Douglas-Peucker simplification keeps: both ends, and far points in turn."""
    if len(lat) < 2:
        # A lone point is both ends of its path.
        return [0, 0] if len(lat) else []
    keep, open_spans = {0, len(lat) - 1}, [(0, len(lat) - 1)]
    while open_spans:
        first, last = open_spans.pop()
        if last - first < 2:
            continue
        far = offset(lat, lon, first, last)
        at = int(np.argmax(far))
        if far[at] > epsilon:
            split = first + 1 + at
            keep.add(split)
            open_spans += [(first, split), (split, last)]
    return sorted(keep)


def kept_of_all(lat: np.ndarray, lon: np.ndarray, n: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """``kept_points`` of many paths that lie one after the other, ``n`` points each: all positions, and how many per path.

    The open spans of all paths are split together, one round per depth.
    """
    owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    first, last = start[n > 0], (start + n - 1)[n > 0]
    keep = np.bincount(first, minlength=len(lat)) + np.bincount(last, minlength=len(lat))
    while (wide := last - first >= 2).any():
        first, last = first[wide], last[wide]
        inner = last - first - 1
        begin = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(first)), inner)
        a, z, at = first[span], last[span], np.arange(len(span)) + (first + 1 - begin)[span]
        arc = distance(lat[a], lon[a], lat[at], lon[at]) / EARTH_RADIUS_M
        turn = course(lat[a], lon[a], lat[z], lon[z]) - course(lat[a], lon[a], lat[at], lon[at])
        far = np.abs(np.arcsin(np.sin(arc) * np.sin(turn))) * EARTH_RADIUS_M
        top = np.maximum.reduceat(far, begin)[span]
        places = np.flatnonzero((far == top) & (top > epsilon))
        split, once = np.unique(span[places], return_index=True)
        middle = at[places[once]]
        keep[middle] = 1
        first, last = np.concatenate([first[split], middle]), np.concatenate([middle, last[split]])
    return np.repeat(np.arange(len(lat)) - start[owner], keep), np.bincount(owner, keep, len(n)).astype(np.int64)


def simplify_positions(lat: Column, lon: Column, epsilon: float) -> Column:
    """Kept positions of each path given as two arrays."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def positions(lats: pa.Array, lons: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(lats), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n)
        points = [c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (lats, lons)]
        # Paths are taken in runs of so many points, which bounds what is held beside the batch.
        runs = np.unique(np.searchsorted(end, np.arange(0, end[-1] if len(end) else 0, RUN_POINTS), "left"))
        places, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(int(runs[0]) if len(runs) else len(n), dtype=np.int64)]
        for a, b in zip(runs, [*runs[1:], len(n)]):
            part = slice(end[a] - n[a], end[b - 1])
            kept, of_path = kept_of_all(*(c[part] for c in points), n[a:b], epsilon)
            places.append(kept)
            counts.append(of_path)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(places), pa.int32()))
    return positions(lat, lon)


def frechet(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Discrete Frechet metres of m path pairs, given as (m, n1) and (m, n2) arrays; one row of the table is held."""
    gaps = lambda i: distance(lat1[:, i, None], lon1[:, i, None], lat2, lon2)
    reach = np.maximum.accumulate(gaps(0), axis=1)
    for i in range(1, lat1.shape[1]):
        gap = gaps(i)
        # The cheaper of the two ways in from the row above; the way along the row is taken in turn.
        above = reach.copy()
        above[:, 1:] = np.minimum(reach[:, 1:], reach[:, :-1])
        row = np.maximum(above, gap)
        for j in range(1, gap.shape[1]):
            row[:, j] = np.minimum(row[:, j], np.maximum(row[:, j - 1], gap[:, j]))
        reach = row
    return reach[:, -1]


@F.pandas_udf(DoubleType())
def _frechet_metres(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Frechet distance per row, not a number for rows without paths; rows of equal lengths are computed together."""
    out = np.full(len(lat1), np.nan)
    some = np.flatnonzero(lat1.notna())
    if not len(some):
        return pd.Series(out)
    lat1, lon1, lat2, lon2 = (s.iloc[some] for s in (lat1, lon1, lat2, lon2))
    shapes = pd.Series([(len(a), len(b)) for a, b in zip(lat1, lat2)])
    for places in shapes.groupby(shapes).indices.values():
        # Large batches of long paths are cut so that their points stay few.
        points = len(lat1.iloc[places[0]]) + len(lat2.iloc[places[0]])
        step = max(1, 1_000_000 // max(1, points))
        for start in range(0, len(places), step):
            part = places[start:start + step]
            out[some[part]] = frechet(*[np.stack(list(s.iloc[part])) for s in (lat1, lon1, lat2, lon2)])
    return pd.Series(out)


# Marked so that a filter on the distance does not make the optimizer compute it twice.
frechet_metres = _frechet_metres.asNondeterministic()


def ward_merges(centre: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all Ward merges of weighted points by nearest-neighbour chains; a merged pair goes on as its lesser number."""
    n = len(centre)
    centre, weight = centre.astype(float).copy(), weight.astype(float).copy()
    alive, merges, chain = np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            cost = weight * weight[at] / (weight + weight[at]) * ((centre - centre[at]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[at] = np.inf
            near = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = min(at, near), max(at, near)
        merges.append((float(cost[near]), a, b))
        centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        alive[b] = False
        del chain[-2:]
    return merges


def direction(lat: Column, lon: Column) -> Column:
    """Planar direction from first to last point in radians."""
    return F.atan2(F.element_at(lon, -1) - F.get(lon, F.lit(0)), F.element_at(lat, -1) - F.get(lat, F.lit(0)))


def lat_degrees(metres: float) -> float:
    return math.degrees(metres / EARTH_RADIUS_M)


def lon_reach(metres: float, max_abs_lat: Column) -> Column:
    """Degrees of longitude no pair of points within ``metres`` can exceed up to a latitude; 360 around a pole."""
    shrink = F.cos(F.radians(max_abs_lat))
    ratio = math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2))
    return F.when(shrink <= ratio, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.lit(ratio) / shrink)))
