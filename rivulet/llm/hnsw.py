"""Hierarchical navigable small-world graph over unit vectors, in numpy.

Nodes enter in batches; each batch searches the graph so far. Links are chosen
so that they point in different directions, which keeps groups of near copies
tied to the rest. Searches work on many queries at once.
"""

from __future__ import annotations

import pickle

import numpy as np


class Hnsw:
    def __init__(self, vectors: np.ndarray, m: int = 12, ef: int = 48, seed: int = 0):
        """``vectors``: one unit vector of float32 in each row."""
        self.x, self.m = np.ascontiguousarray(vectors, dtype=np.float32), m
        n = len(self.x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # lowest first: nodes of the layer, their links (-1: none)
        for k in range(int(level.max()) + 1 if n else 0):
            nodes = np.flatnonzero(level >= k)
            self.layers.append((nodes, self._layer(nodes, 2 * m if k == 0 else m, ef)))

    def _layer(self, nodes: np.ndarray, width: int, ef: int) -> np.ndarray:
        """Links of one layer, as positions in ``nodes``."""
        x, n = self.x[nodes], len(nodes)
        links = np.full((n, width), -1, dtype=np.int32)
        done = min(n, 2 * width)
        if done > 1:
            self._connect(links, x, np.arange(done), *_top(x[:done] @ x[:done].T, done))
        while done < n:
            size = min(n - done, done, 1024)
            new = np.arange(done, done + size)
            sims, found = _search(x, links, x[new], _entries(done, size), min(ef, done), done)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -2.0)
            near_s, near = _top(own, min(width, size))
            near = near + done
            near[near_s < -1.5] = -1
            self._connect(links, x, new, np.concatenate([sims, near_s], axis=1), np.concatenate([found, near], axis=1))
            done += size
        return links

    def _connect(self, links: np.ndarray, x: np.ndarray, new: np.ndarray, sims: np.ndarray, found: np.ndarray) -> None:
        width = links.shape[1]
        incoming: dict[int, list[int]] = {}
        for i, s, c in zip(new.tolist(), sims, found, strict=True):
            keep = (c >= 0) & (c != i)
            order = np.argsort(-s[keep], kind="stable")
            chosen = _diverse(x, c[keep][order], s[keep][order], width // 2)
            links[i, : len(chosen)] = chosen
            for j in chosen:
                incoming.setdefault(int(j), []).append(i)
        for j, others in incoming.items():
            old = links[j][links[j] >= 0]
            every = np.unique(np.concatenate([old, np.array(others, dtype=np.int32)]))
            if len(every) > width:
                s = x[every] @ x[j]
                order = np.argsort(-s, kind="stable")
                every = _diverse(x, every[order], s[order], width)
            links[j] = -1
            links[j, : len(every)] = every

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and nodes of the ``ef`` best found for each query, best first; node -1: none."""
        entry = None
        for k in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[k]
            if entry is None:
                start = _entries(len(nodes), len(queries))
            else:
                start = np.where(entry >= 0, np.searchsorted(nodes, entry), -1)
            width = ef if k == 0 else 8
            sims, at = _search(self.x[nodes], links, queries, start, min(width, len(nodes)), len(nodes))
            entry = np.where(at >= 0, nodes[at], -1)
        return sims, entry

    def dumps(self) -> bytes:
        return pickle.dumps((self.x, self.m, self.layers), protocol=5)

    @classmethod
    def loads(cls, data: bytes) -> Hnsw:
        found = cls.__new__(cls)
        found.x, found.m, found.layers = pickle.loads(data)
        return found


def _entries(n: int, queries: int, k: int = 4) -> np.ndarray:
    """A few fixed starting points, spread over the first n nodes."""
    return np.tile(np.unique(np.linspace(0, n - 1, k).astype(np.int64)), (queries, 1))


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, axis=1), order


def _diverse(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of nodes, nearest first, those nearer to the centre than to any chosen one; then the nearest others."""
    nodes, sims = nodes[: 4 * most], sims[: 4 * most]
    if len(nodes) <= most:
        return nodes
    between = x[nodes] @ x[nodes].T
    chosen: list[int] = []
    for i in range(len(nodes)):
        if not chosen or (between[i, chosen] < sims[i]).all():
            chosen.append(i)
            if len(chosen) == most:
                break
    for i in range(len(nodes)):
        if len(chosen) == most:
            break
        if i not in chosen:
            chosen.append(i)
    return nodes[chosen]


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, n: int, step: int = 256, grow: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once over the first n nodes of a layer."""
    all_s, all_c = [], []
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column stands for no node
        seen[:, n] = True
        beam_c = np.full((len(q), ef), -1, dtype=np.int64)
        beam_s = np.full((len(q), ef), -3.0, dtype=np.float32)
        opened = np.ones((len(q), ef), dtype=bool)
        fresh = entry[at : at + step]
        active = np.arange(len(q))
        while len(active):
            c = np.where((fresh < 0) | (fresh >= n), n, fresh)
            c = np.sort(c, axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = n
            r = active[:, None]
            c = np.where(seen[r, c], n, c)
            seen[r, c] = True
            s = np.einsum("qkd,qd->qk", x[np.minimum(c, n - 1)], q[active])
            s = np.where(c == n, np.float32(-3.0), s)
            every_s = np.concatenate([beam_s[active], s], axis=1)
            every_c = np.concatenate([beam_c[active], np.where(c == n, -1, c)], axis=1)
            every_o = np.concatenate([opened[active], c == n], axis=1)
            order = np.argsort(-every_s, axis=1, kind="stable")[:, :ef]
            beam_s[active] = np.take_along_axis(every_s, order, axis=1)
            beam_c[active] = np.take_along_axis(every_c, order, axis=1)
            opened[active] = np.take_along_axis(every_o, order, axis=1)
            active = active[~opened[active].all(axis=1)]
            if not len(active):
                break
            # the best few that are not opened yet
            o = opened[active]
            nth = np.cumsum(~o, axis=1)
            pick = ~o & (nth <= grow)
            opened[active] = o | pick
            best = np.argsort(~pick, axis=1, kind="stable")[:, :grow]
            valid = np.take_along_axis(pick, best, axis=1)
            centre = np.where(valid, beam_c[active[:, None], best], -1)
            fresh = np.where(centre[:, :, None] >= 0, links[np.maximum(centre, 0)], -1).reshape(len(active), -1)
        all_s.append(beam_s)
        all_c.append(beam_c)
    return np.concatenate(all_s), np.concatenate(all_c)
