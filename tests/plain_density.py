"""A plain, one-process statement of the condensed tree and its selection, for the clustering tests."""

import numpy as np

MIN_CLUSTER_SIZE = 2


def _find(parent: dict, x):
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def spanning_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Kruskal: indices of a minimum spanning forest (ties broken by (d, a, b))."""
    order = np.lexsort((b, a, d))
    parent: dict = {}
    keep = []
    for i in order:
        u, v = int(a[i]), int(b[i])
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        ru, rv = _find(parent, u), _find(parent, v)
        if ru != rv:
            parent[ru] = rv
            keep.append(i)
    return np.asarray(keep, dtype=np.int64)


def _lambda(dist: float) -> float:
    return 1.0 / dist if dist > 0.0 else np.inf


def island_clusters(a: np.ndarray, b: np.ndarray, d: np.ndarray, birth: float, selectable_root: bool,
                    min_size: int = MIN_CLUSTER_SIZE) -> dict[int, int]:
    """Condense + excess-of-mass selection for one island given its (spanning) edges.

    Returns ``{node: cluster_key}`` for clustered nodes; ``cluster_key`` is the smallest node of
    the selected cluster (stable across runs and partitionings).
    """
    keep = spanning_forest(a, b, d)
    a, b, d = a[keep], b[keep], d[keep]
    order = np.lexsort((b, a, d))
    nodes = np.unique(np.concatenate([a, b]))
    n = len(nodes)
    index = {int(v): i for i, v in enumerate(nodes)}
    # single-linkage tree: leaves 0..n-1, merges n..2n-2
    parent = list(range(2 * n - 1))
    children: dict[int, tuple[int, int]] = {}
    height: dict[int, float] = {}
    size = [1] * n + [0] * (n - 1)
    nxt = n
    for i in order:
        ru, rv = _find_list(parent, index[int(a[i])]), _find_list(parent, index[int(b[i])])
        children[nxt] = (ru, rv)
        height[nxt] = float(d[i])
        size[nxt] = size[ru] + size[rv]
        parent[ru] = parent[rv] = nxt
        nxt += 1
    top = nxt - 1

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack.extend(children[x])
        return out

    # condensed tree: clusters with birth λ, parent; point exits (cluster, λ)
    cl_birth = {0: birth}
    cl_parent: dict[int, int] = {}
    cl_children: dict[int, list[int]] = {0: []}
    stability = {0: 0.0}
    point_exit: dict[int, tuple[int, float]] = {}
    stack = [(top, 0)]
    next_label = 1
    while stack:
        node, label = stack.pop()
        if node < n:                       # a single point left as the whole cluster
            point_exit[node] = (label, np.inf)
            stability[label] += np.inf - cl_birth[label] if np.isfinite(cl_birth[label]) else 0.0
            continue
        lam = _lambda(height[node])
        left, right = children[node]
        big = [c for c in (left, right) if size[c] >= min_size]
        if len(big) == 2:
            for c in (left, right):
                new = next_label
                next_label += 1
                cl_birth[new], cl_parent[new] = lam, label
                cl_children[new] = []
                cl_children[label].append(new)
                stability[new] = 0.0
                stability[label] += (lam - cl_birth[label]) * size[c]
                stack.append((c, new))
        else:
            for c in (left, right):
                if size[c] >= min_size:
                    stack.append((c, label))
                else:
                    for leaf in leaves(c):
                        point_exit[leaf] = (label, lam)
                        stability[label] += lam - cl_birth[label]
    # excess of mass, children before parents (labels grow with depth)
    selected = {c: True for c in cl_birth}
    for c in sorted(cl_birth, reverse=True):
        kids = cl_children[c]
        sub = sum(stability[k] for k in kids)
        if c == 0 and not selectable_root:
            selected[c] = False
            continue
        if kids and sub > stability[c]:
            selected[c] = False
            stability[c] = sub
        else:
            todo = list(kids)
            while todo:
                k = todo.pop()
                selected[k] = False
                todo.extend(cl_children[k])
    # label points: nearest selected ancestor of the cluster a point left
    members: dict[int, list[int]] = {}
    for leaf, (c, _) in point_exit.items():
        x = c
        while x is not None and not selected[x]:
            x = cl_parent.get(x)
        if x is not None:
            members.setdefault(x, []).append(int(nodes[leaf]))
    out: dict[int, int] = {}
    for _, pts in members.items():
        key = min(pts)
        for p in pts:
            out[p] = key
    return out


def _find_list(parent: list, x: int) -> int:
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root
