"""HDBSCAN, PCA and silhouette in NumPy for the rows of one document (Campello et al. 2013; McInnes & Healy 2017)."""

from __future__ import annotations

import numpy as np

from ..config import Config

#: Rows of which the matrix of all distances is held.
SQUARE = 256


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0))


def _row(x: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(((x - x[i]) ** 2).sum(-1))


def _few(x: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Prim's tree of the reach between rows, as (distance, from, to): by the matrix of distances, with Python's numbers."""
    apart = distances(x)
    core = np.partition(apart, k, axis=1)[:, k]  # the row itself is at place 0
    reach = np.maximum(np.maximum(apart, core[None, :]), core[:, None]).tolist()
    left, source, edges, at = list(range(1, len(x))), [0] * len(x), [], 0
    best = [np.inf] * len(x)
    while left:
        row, least, to = reach[at], np.inf, -1
        for j in left:
            d = row[j]
            if d < best[j]:
                best[j], source[j] = d, at
            else:
                d = best[j]
            if d < least or to < 0:
                least, to = d, j
        edges.append((least, source[to], to))
        left.remove(to)
        at = to
    return edges


def _many(x: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """The same, row by row."""
    n = len(x)
    core = np.array([np.partition(_row(x, i), k)[k] for i in range(n)])
    best, source, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(_row(x, at), core), core[at])
        nearer = ~inside & (reach < best)
        best[nearer], source[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), int(source[at]), at))
    return edges


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int, allow_single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise), numbered by first row, and membership probabilities; excess of mass.

    Equal distances are one level: what they join, joins at once, whatever the order of rows. Beyond SQUARE rows distances
    are made row by row, so memory grows with the rows and not with their square.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    k = min(min_samples, n - 1)
    edges = (_few if n <= SQUARE else _many)(x, k)
    # single linkage: a node joins two or more nodes, all that a distance joins
    parent, children, height, size = list(range(2 * n - 1)), {}, {}, [1] * n

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges.sort()
    first = 0
    while first < len(edges):
        last = first
        while last < len(edges) and edges[last][0] == edges[first][0]:
            last += 1
        joined: dict[int, set[int]] = {}
        for _, a, b in edges[first:last]:
            a, b = top(a), top(b)
            both = joined.pop(a, {a}) | joined.pop(b, {b})
            parent[b] = a
            joined[a] = both
        for root, nodes in sorted(joined.items()):
            new = len(size)
            for i in nodes:
                parent[i] = new
            children[new], height[new] = tuple(sorted(nodes)), edges[first][0]
            size.append(sum(size[i] for i in nodes))
        first = last

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += children[k]
        return out

    # condensed tree: each cluster's birth, the points that leave it and when, and its two heirs
    clusters = [{"birth": 0.0, "points": {}, "heirs": [], "node": len(size) - 1, "up": None}]
    todo = [0]
    while todo:
        c = todo.pop(0)
        node = clusters[c]["node"]
        while True:
            if node < n:
                clusters[c]["points"][node] = clusters[c]["last"] if "last" in clusters[c] else np.inf
                break
            level = 1 / height[node] if height[node] > 0 else np.inf
            clusters[c]["last"] = level
            big = [k for k in children[node] if size[k] >= min_cluster_size]
            for k in children[node]:
                if k not in big:
                    clusters[c]["points"] |= dict.fromkeys(leaves(k), level)
            if len(big) > 1:
                for k in big:
                    clusters[c]["heirs"].append(len(clusters))
                    todo.append(len(clusters))
                    clusters.append({"birth": level, "points": {}, "heirs": [], "node": k, "up": c})
                clusters[c]["split"] = (level, sum(size[k] for k in big))
                break
            if not big:
                break
            node = big[0]
    finite = [v for c in clusters for v in (*c["points"].values(), c["birth"]) if np.isfinite(v)]
    cap = 2 * max(finite, default=1.0) + 1  # rows at no distance: later than all others, yet finite
    late = lambda v: v if np.isfinite(v) else cap
    stable = [sum(late(v) - late(c["birth"]) for v in c["points"].values()) + (("split" in c) and (late(c["split"][0]) - late(c["birth"])) * c["split"][1] or 0.0) for c in clusters]
    chosen = [False] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(stable[k] for k in clusters[c]["heirs"])
        if (c or allow_single) and (not clusters[c]["heirs"] or stable[c] >= below):
            chosen[c] = True
        else:
            stable[c] = below
    for c, x_ in enumerate(clusters):
        up = x_["up"]
        while chosen[c] and up is not None:
            chosen[c] = not chosen[up]
            up = clusters[up]["up"]
    labels, probability = np.full(n, -1), np.zeros(n)
    for c in [i for i, ok in enumerate(chosen) if ok]:
        points, todo = {}, [c]
        while todo:
            k = todo.pop()
            points |= {p: late(v) for p, v in clusters[k]["points"].items()}
            todo += clusters[k]["heirs"]
        most = max(points.values())
        for p, v in points.items():
            labels[p], probability[p] = c, 1.0 if most == 0 else v / most
    number = {c: i for i, c in enumerate(dict.fromkeys(labels[labels >= 0].tolist()))}
    return np.array([number.get(c, -1) for c in labels.tolist()]), probability


def guard(x: np.ndarray, valid: np.ndarray, config: Config) -> str:
    """The first rule that decides a document without clustering, or cluster."""
    n = len(x)
    if config.skip_clustering or n < config.min_paragraphs or valid.sum() < config.min_valid_to_cluster:
        return "skipped"
    if n < 2 * config.min_cluster_size:
        return "too_short"
    varying = int((x.var(0) >= config.least_variance).sum()) if n else 0
    return "zero_variance" if varying == 0 else "one_column" if varying < 2 else "cluster"


def cluster(x: np.ndarray, config: Config, n_semantic: int = 0) -> tuple[np.ndarray, np.ndarray, str]:
    """Labels of one document's feature rows, probabilities, and the outcome: drop constant columns, scale, weigh semantics, cluster.

    Mostly noise is one author (noise_override), and so is a document that scaling or clustering fails on (failed).
    """
    varying = x.var(0) >= config.least_variance
    try:
        z = (x[:, varying] - x[:, varying].mean(0)) / x[:, varying].std(0)
        if n_semantic and varying.all():
            z[:, -n_semantic:] *= config.semantic_weight
        labels, probability = hdbscan(z, config.min_cluster_size, config.min_samples, config.allow_single_cluster)
    except (ArithmeticError, LookupError, ValueError, MemoryError):
        return np.zeros(len(x), int), np.ones(len(x)), "failed"
    if (labels == -1).mean() > config.noise_limit:
        return np.zeros(len(x), int), np.full(len(x), config.override_confidence), "noise_override"
    return labels, probability, "cluster"


def pca(x: np.ndarray, components: int = 3) -> np.ndarray:
    """Centred projection on at most `components` axes, the largest loading positive, padded with zeros."""
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[: min(components, len(x), x.shape[1])]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    out = np.zeros((len(x), components))
    out[:, : len(axes)] = centred @ axes.T
    return out
