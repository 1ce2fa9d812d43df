"""Small seeded inputs and sequential numpy versions of the iterative operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unit(rows):
    rows = np.asarray(rows, float)
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n > 0, n, 1)


def clustered(seed: int, n: int, dim: int = 8, centres: int = 6, noise: float = 0.35, copies: int = 0):
    """Noisy points around a few centres; the last ``copies`` rows repeat row 0 exactly."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))
    rows = rows.astype(np.float32)
    if copies:
        rows = np.vstack([rows, np.repeat(rows[:1], copies, axis=0)])
    return rows


def frame(spark, rows, **columns):
    """Cached table of (seq, embedding, ...) in two partitions."""
    arrays = {
        "seq": pa.array(range(len(rows)), pa.int64()),
        "embedding": pa.array([[float(x) for x in row] for row in rows], pa.list_(pa.float32())),
    }
    for name, values in columns.items():
        kind = pa.string() if any(isinstance(v, str) for v in values) else pa.int64()
        arrays[name] = pa.array(list(values), kind)
    return spark.createDataFrame(pa.table(arrays)).coalesce(2).cache()


def leaders(rows, threshold, strict=False):
    u = unit(rows)
    s = np.round(u @ u.T, 12)
    found, label = [], []
    for i in range(len(u)):
        if found:
            best = max(found, key=lambda j: (s[i, j], -j))
            if s[i, best] > threshold if strict else s[i, best] >= threshold:
                label.append(best)
                continue
        found.append(i)
        label.append(i)
    return label


def components(rows, threshold):
    u = unit(rows)
    near = np.round(u @ u.T, 12) >= threshold
    root = list(range(len(u)))
    changed = True
    while changed:
        changed = False
        for i in range(len(u)):
            low = min(root[j] for j in range(len(u)) if near[i, j] or i == j)
            if low < root[i]:
                root[i], changed = low, True
    return root


def average_linkage(rows, threshold):
    """One merge at a time on the full matrix of average cosines."""
    u = unit(rows)
    groups = {i: [i] for i in range(len(u))}
    s = u @ u.T
    while len(groups) > 1:
        best = max(
            ((np.mean(s[np.ix_(groups[a], groups[b])]), -a, -b) for a in groups for b in groups if a < b),
        )
        if best[0] <= threshold:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return {i: g for g, members in groups.items() for i in members}


def same_partition(a, b) -> bool:
    """Two labelings group the items alike."""
    pairs = set(zip(a, b, strict=True))
    return len(pairs) == len(set(a)) == len(set(b))
