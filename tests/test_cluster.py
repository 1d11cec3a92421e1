"""Buckets of crowded cells: the same by tasks of any size, and as plain k-means over every point gives them."""

from __future__ import annotations

import random

import numpy as np

from quernel.operators import cluster


def _plain(points: list[tuple[str, float, float]], target: int) -> list[list[str]]:
    points = sorted(points)
    at = np.array([p[1:] for p in points])
    k = -(-len(at) // target)
    centres = at[(np.arange(k) * len(at)) // k].copy()
    for last in range(21):
        a, b = np.radians(at[:, None]), np.radians(centres[None])
        label = np.argmin(np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2, axis=1)
        new = np.array([at[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
        moved, centres = np.abs(new - centres).max(), new
        if last == 20 or moved <= 1e-4:
            break
    return sorted(m for c in range(k) if len(m := [p[0] for p, x in zip(points, label) if x == c]) >= 3)


def test_geo_grid_clusters_crowded(spark):
    draw = random.Random(5)
    points = [(f"{i:04}", 10 + draw.random() * 0.4, 20 + draw.random() * 0.4) for i in range(300)] + [(f"s{i:04}", 10.2, 20.2) for i in range(400)]
    points += [(f"t{i}", 10.399, 20.01 + i * 0.0001) for i in range(3)]
    frame = spark.createDataFrame(points, "id string, lat double, lng double")
    wanted = _plain(points, 5)
    for most in (cluster.TASK_SPOTS, 40):
        found = cluster.buckets(frame, "id", "lat", "lng", target=5, grid_km=5000.0, most=most).collect()
        assert sorted(r.members for r in found) == wanted
        assert all(r.n == len(r.members) for r in found)
