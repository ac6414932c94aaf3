"""A hierarchical navigable small-world graph over the unit vectors of one shard, inside a task.

Vectors within ``radius`` of an earlier one join its group instead of the graph, so that a crowd
of near copies is one node and cannot wall off the rest. Nodes are added and searched in
batches of whole-array steps. A beam that is full of hits is widened until it is not.
"""

from __future__ import annotations

import numpy as np

DEGREE, BATCH, BUILD_BEAM, FIRST_BEAM, EXPAND, KEEP, WIDEN, WHOLE = 16, 256, 48, 64, 4, 48, 4, 8
AUDITS, RECALL = 256, 0.99


def diversified(sims: np.ndarray, gram: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """Mask of the candidates (nearest first) nearer to the node than to any kept one, then of the nearest others."""
    kept = np.zeros(sims.shape, bool)
    n = np.zeros(len(sims), int)
    for j in range(sims.shape[1]):
        kept[:, j] = valid[:, j] & (n < most) & (sims[:, j] > np.where(kept, gram[:, j, :], -2).max(1))
        n += kept[:, j]
    rest = valid & ~kept
    return kept | rest & (np.cumsum(rest, 1) <= (most - n)[:, None])


class Graph:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        """``vectors`` and ``levels`` have room for all nodes; with ``links`` the graph is whole."""
        self.vectors, self.levels = vectors, levels
        self.links = links or [np.full((len(vectors), DEGREE * (2 - bool(layer))), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
        self.size = len(vectors) if links else 0

    # -- search

    def descend(self, queries: np.ndarray) -> np.ndarray:
        """The node from which the lowest layer is searched, by greedy steps through the upper ones."""
        at = np.full(len(queries), int(self.levels[:self.size].argmax()))
        near = queries @ self.vectors[at[0]] if len(at) else np.zeros(0, np.float32)
        for layer in range(int(self.levels[at[0]]) if len(at) else 0, 0, -1):
            moving = np.arange(len(at))
            while len(moving):
                next_to = self.links[layer][at[moving]]
                sims = np.einsum("qkd,qd->qk", self.vectors[next_to], queries[moving])
                sims[next_to < 0] = -2
                best = sims.argmax(1)
                better = sims[np.arange(len(moving)), best] > near[moving]
                moving, next_to, sims, best = moving[better], next_to[better], sims[better], best[better]
                at[moving], near[moving] = next_to[np.arange(len(moving)), best], sims[np.arange(len(moving)), best]
        return at

    def beam(self, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities, ``width`` for each query in no order; -1 where there are fewer."""
        n, lowest = len(queries), self.links[0]
        ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
        done, seen = np.zeros((n, width), bool), np.zeros((n, self.size), bool)
        for column in range(min(start.shape[1], width)):
            new = ~seen[np.arange(n), start[:, column]]
            seen[np.arange(n), start[:, column]] = True
            ids[new, column] = start[new, column]
            sims[new, column] = np.einsum("qd,qd->q", queries[new], self.vectors[start[new, column]])
        rows, expand = np.arange(n), min(EXPAND, width)
        while len(rows):
            waiting = np.where(done[rows], -np.inf, sims[rows])
            pick = np.argpartition(-waiting, expand - 1, axis=1)[:, :expand]
            good = np.take_along_axis(waiting, pick, 1) > -np.inf
            busy = good.any(1)
            rows, pick, good = rows[busy], pick[busy], good[busy]
            if not len(rows):
                break
            done[rows[:, None], pick] = True
            found = np.where(good[:, :, None], lowest[np.where(good, ids[rows[:, None], pick], 0)], -1).reshape(len(rows), -1)
            found.sort(axis=1)
            valid = (found >= 0) & ~seen[rows[:, None], found]
            valid[:, 1:] &= found[:, 1:] != found[:, :-1]
            r, c = np.nonzero(valid)
            seen[rows[r], found[r, c]] = True
            got = np.full(found.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("pd,pd->p", queries[rows[r]], self.vectors[found[r, c]])
            all_sims = np.concatenate([sims[rows], got], 1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(all_sims, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(valid, found, -1)], 1), top, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(found.shape, bool)], 1), top, 1)
        return ids, sims

    def within(self, queries: np.ndarray, low: float, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of similarity ``low`` or more that beams of ``width`` find; a beam full of
        hits is widened, and where it would hold an eighth of the shard (``WHOLE``) all nodes are compared.
        ``own``: a node of the shard that the query belongs to, where the search starts too (or -1)."""
        pairs = []
        for at in range(0, len(queries), BATCH):
            rows, wide = np.arange(at, min(at + BATCH, len(queries))), width
            while len(rows):
                if wide * WHOLE >= self.size:
                    r, nodes = np.nonzero(queries[rows] @ self.vectors[:self.size].T >= low)
                    pairs.append((rows[r], nodes))
                    break
                start = self.descend(queries[rows])[:, None]
                if own is not None:
                    start = np.concatenate([start, np.where(own[rows] < 0, start[:, 0], own[rows])[:, None]], 1)
                ids, sims = self.beam(queries[rows], start, wide)
                hit = (sims >= low) & (ids >= 0)
                full = hit.all(1)
                r, c = np.nonzero(hit & ~full[:, None])
                pairs.append((rows[r], ids[r, c]))
                rows, wide = rows[full], WIDEN * wide
        return tuple(np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))

    # -- building

    def grow(self, new: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> None:
        """Link the nodes ``new`` (already in ``vectors``) in all their layers; their candidates in the lowest one are given."""
        self._link(0, new, candidates, sims)
        for layer in range(1, len(self.links)):
            own = new[self.levels[new] >= layer]
            if len(own):
                nodes = np.nonzero(self.levels[:self.size] >= layer)[0]
                near = self.vectors[own] @ self.vectors[nodes].T
                near[own[:, None] == nodes[None, :]] = -np.inf
                order = np.argsort(-near, axis=1)[:, :KEEP]
                near = np.take_along_axis(near, order, 1)
                self._link(layer, own, np.where(near > -np.inf, nodes[order], -1).astype(np.int32), near)

    def _link(self, layer: int, new: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> None:
        valid = candidates >= 0
        vectors = self.vectors[np.where(valid, candidates, 0)]
        kept = diversified(sims, vectors @ vectors.transpose(0, 2, 1), valid, DEGREE)
        r, c = np.nonzero(kept)
        self.links[layer][new[r], np.cumsum(kept, 1)[r, c] - 1] = candidates[r, c]
        self._link_back(layer, candidates[r, c], new[r], sims[r, c])

    def _link_back(self, layer: int, to: np.ndarray, source: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[layer]
        room = links.shape[1]
        order = np.lexsort((-sims, to))
        to, source = to[order], source[order]
        targets, first, inverse = np.unique(to, return_index=True, return_inverse=True)
        rank = np.arange(len(to)) - first[inverse]
        near = rank < room  # a node keeps its nearest neighbours only
        added = np.full((len(targets), room), -1, np.int32)
        added[inverse[near], rank[near]] = source[near]
        for at in range(0, len(targets), 512):
            nodes, old, more = targets[at:at + 512], links[targets[at:at + 512]], added[at:at + 512]
            more = np.where((more[:, :, None] == old[:, None, :]).any(2), -1, more)
            both = np.concatenate([old, more], 1)
            valid = both >= 0
            fits = valid.sum(1) <= room
            front = np.take_along_axis(both, np.argsort(~valid, axis=1, kind="stable"), 1)[:, :room]
            links[nodes[fits]] = front[fits]
            nodes, both, valid = nodes[~fits], both[~fits], valid[~fits]
            if len(nodes):
                vectors = self.vectors[np.where(valid, both, 0)]
                close = np.where(valid, np.einsum("tkd,td->tk", vectors, self.vectors[nodes]), -np.inf)
                order = np.argsort(-close, axis=1)
                vectors = np.take_along_axis(vectors, order[:, :, None], 1)
                both, valid, close = (np.take_along_axis(x, order, 1) for x in (both, valid, close))
                kept = diversified(close, vectors @ vectors.transpose(0, 2, 1), valid, room)
                links[nodes] = np.take_along_axis(np.where(kept, both, -1), np.argsort(~kept, axis=1, kind="stable"), 1)[:, :room]


def built(units: np.ndarray, levels: np.ndarray, same: float) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph, the rows of ``units`` that became nodes, and the node of every row: a row of similarity ``same`` or more joins a node."""
    graph = Graph(np.zeros(units.shape, np.float32), np.zeros(len(units), np.int8))
    graph.links = [np.full((len(units), DEGREE * (2 - bool(layer))), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
    leaders, node_of, at = np.zeros(len(units), np.int64), np.full(len(units), -1, np.int64), 0
    while at < len(units):
        rows = np.arange(at, min(len(units), at + min(BATCH, max(1, graph.size))))
        at, batch = rows[-1] + 1, units[rows].astype(np.float32)
        if graph.size <= BUILD_BEAM:
            near = batch @ graph.vectors[:graph.size].T
            ids = np.broadcast_to(np.arange(graph.size, dtype=np.int32), near.shape)
        else:
            ids, near = graph.beam(batch, graph.descend(batch)[:, None], BUILD_BEAM)
        if graph.size:
            best = near.argmax(1)
            of = ids[np.arange(len(rows)), best]
            close = np.einsum("qd,qd->q", units[rows], units[leaders[of]]) >= same
            node_of[rows[close]] = of[close]
        each = batch @ batch.T
        new: list[int] = []
        for i in np.nonzero(node_of[rows] < 0)[0]:
            if new and units[rows[i]] @ units[rows[new[int(each[i, new].argmax())]]] >= same:
                node_of[rows[i]] = node_of[rows[new[int(each[i, new].argmax())]]]
            else:
                node_of[rows[i]] = graph.size + len(new)
                new.append(i)
        if not new:
            continue
        nodes = np.arange(graph.size, graph.size + len(new))
        leaders[nodes], graph.vectors[nodes], graph.levels[nodes] = rows[new], batch[new], levels[rows[new]]
        mates = each[np.ix_(new, new)]
        np.fill_diagonal(mates, -np.inf)
        sims = np.concatenate([np.where(ids[new] >= 0, near[new], -np.inf), mates], 1)
        ids = np.concatenate([ids[new], np.broadcast_to(nodes.astype(np.int32), mates.shape)], 1)
        order = np.argsort(-sims, axis=1)[:, :KEEP]
        sims = np.take_along_axis(sims, order, 1)
        graph.size += len(new)
        graph.grow(nodes, np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims)
    n = graph.size
    graph.vectors, graph.levels, graph.links = graph.vectors[:n], graph.levels[:n], [x[:n] for x in graph.links]
    return graph, leaders[:n], node_of


def audited_width(graph: Graph, units: np.ndarray, node_of: np.ndarray, cosine: float, low: float,
                  audits: int = AUDITS, recall: float = RECALL) -> int:
    """The beam at which planted queries, as far from a row of the shard as a link may be, find
    its node ``recall`` of the time; if none does, one at which all nodes are compared."""
    rows = np.unique(np.linspace(0, len(units) - 1, min(audits, len(units))).astype(int))
    away = np.random.default_rng(1).standard_normal((len(rows), units.shape[1]))
    away -= np.einsum("qd,qd->q", away, units[rows])[:, None] * units[rows]
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    queries = (cosine * units[rows] + np.sqrt(1 - cosine**2) * away).astype(np.float32)
    width = FIRST_BEAM
    while width * WHOLE < graph.size:
        q, nodes = graph.within(queries, low, width)
        if len(np.unique(q[nodes == node_of[rows][q]])) >= recall * len(rows):
            break
        width *= 2
    return width
