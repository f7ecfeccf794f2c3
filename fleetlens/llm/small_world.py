"""A hierarchical navigable small-world graph over the vectors of one shard."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np


class SmallWorld:
    """Unit vectors as nodes; layers of links, thinner upwards, that a search follows towards a query.

    ``links`` bounds the neighbours of a node per layer (twice as many on the ground), ``beam`` is how many nodes an
    insertion keeps in sight. A node's neighbours are chosen for being nearer to it than to each other, so that dense
    groups keep links to the rest.
    """

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 32, seed: int = 5) -> None:
        self.vectors, self.links, self.beam = vectors, links, beam
        n = len(vectors)
        draw = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(draw.random(n) + 1e-12) / np.log(links)).astype(int), 8)
        self.ground = np.zeros((n, 2 * links + 1), np.int32)
        self.sizes = np.zeros(n, np.int32)
        self.upper: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)))]
        self.entry, self.top = -1, -1
        for node in range(n):
            self.insert(node)

    def neighbours(self, node: int, level: int) -> np.ndarray:
        if level == 0:
            return self.ground[node, : self.sizes[node]]
        return np.array(self.upper[level - 1].get(node, ()), np.int32)

    def search(self, query: np.ndarray, starts: list[int], beam: int, level: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest nodes in sight, as (similarity, node), nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        seen[starts] = True
        open_nodes, best = [], []
        for node in starts:
            s = float(self.vectors[node] @ query)
            heappush(open_nodes, (-s, node))
            heappush(best, (s, node))
        while open_nodes:
            s, node = heappop(open_nodes)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = self.neighbours(node, level)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, other in zip((self.vectors[near] @ query).tolist(), near.tolist(), strict=True):
                if len(best) < beam or s > best[0][0]:
                    heappush(open_nodes, (-s, other))
                    heappush(best, (s, other))
                    if len(best) > beam:
                        heappop(best)
        return sorted(best, reverse=True)

    def descend(self, query: np.ndarray, level: int) -> int:
        """The node where a search of ``level`` begins: from the top, always to the nearest neighbour."""
        node = self.entry
        s = float(self.vectors[node] @ query)
        for above in range(self.top, level, -1):
            moved = True
            while moved:
                near = self.neighbours(node, above)
                moved = False
                if len(near):
                    sims = self.vectors[near] @ query
                    k = int(np.argmax(sims))
                    if sims[k] > s:
                        node, s, moved = int(near[k]), float(sims[k]), True
        return node

    def choose(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to any chosen before; then the nearest others."""
        order = np.argsort(-sims, kind="stable")
        sims, nodes = sims[order], nodes[order]
        among = self.vectors[nodes] @ self.vectors[nodes].T
        kept, others = [], []
        for i in range(len(nodes)):
            if len(kept) == most:
                break
            (kept if not kept or among[i, kept].max() < sims[i] else others).append(i)
        return nodes[(kept + others)[:most]].tolist()

    def insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        query = self.vectors[node]
        start = [self.descend(query, min(level, self.top))]
        for at in range(min(level, self.top), -1, -1):
            found = self.search(query, start, self.beam, at)
            sims, nodes = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            for other in self.choose(sims, nodes, self.links):
                self.connect(node, other, at)
                self.connect(other, node, at)
            start = nodes[: self.beam].tolist()
        if level > self.top:
            self.entry, self.top = node, level

    def connect(self, node: int, other: int, level: int) -> None:
        near = self.neighbours(node, level)
        if other in near:
            return
        near = np.append(near, other)
        most = 2 * self.links if level == 0 else self.links
        if len(near) > most:
            near = np.array(self.choose(self.vectors[near] @ self.vectors[node], near, most))
        if level == 0:
            self.ground[node, : len(near)] = near
            self.sizes[node] = len(near)
        else:
            self.upper[level - 1][node] = near.tolist()

    def within(self, query: np.ndarray, least: float, beam: int, own: int = -1) -> np.ndarray:
        """Nodes of similarity ``least`` or more: those in the beam, and all that links lead to from them.

        ``own`` is the query's own node, where it has one: the search starts there, too.
        """
        start = {self.descend(query, 0)} | ({own} if own >= 0 else set())
        hits = [node for s, node in self.search(query, sorted(start), beam, 0) if s >= least]
        seen = np.zeros(len(self.vectors), bool)
        seen[hits] = True
        fresh = np.array(hits, np.int64)
        while len(fresh):
            near = np.unique(np.concatenate([self.ground[k, : self.sizes[k]] for k in fresh.tolist()]))
            near = near[~seen[near]]
            fresh = near[self.vectors[near] @ query >= least]
            seen[fresh] = True
        return np.flatnonzero(seen)


def audited_beam(graph: SmallWorld, asked: np.ndarray, least: float, beam: int, recall: float, sample: int) -> int:
    """A beam that finds enough of what brute force finds at ``least``, doubled until it does.

    The audit asks with up to ``sample`` of the vectors that will be asked, evenly spaced, and does not tell the
    search where they are; of these, only vectors near any node say something, so more are taken until ``sample`` of
    them do or four times as many were looked at. Brute force compares blocks of them with all nodes.
    """
    n, queries, wanted = len(graph.vectors), [], []
    step = max(1, len(asked) // sample)
    for offset in range(step):
        block = asked[offset::step]
        near = block @ graph.vectors.T >= least
        if asked is graph.vectors:  # a node is no link of its own
            near[np.arange(len(block)), np.arange(offset, n, step)] = False
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            queries.append(block[k])
            wanted.append(np.flatnonzero(near[k]))
        if len(queries) >= sample or (offset + 1) * len(block) >= 4 * sample:
            break
    total = sum(map(len, wanted))
    while beam < n:
        found = sum(np.isin(w, graph.within(q, least, beam)).sum() for q, w in zip(queries, wanted, strict=True))
        if found >= recall * total:
            break
        beam *= 2
    return beam
