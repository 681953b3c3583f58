"""Segmentation lattices of many words at once, and sampling from them.

The lattice of a text is the chain of the lattices of its words: no piece holds a word
boundary inside. So each distinct word is laid out once, with the probability of every
piece at every place given what is left of the word, and texts are walks over these.
"""

from __future__ import annotations

from collections import deque

import numpy as np

from titlesieve.llm.textscan import mix, prefix_hash, ragged, span_hash

MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BUCKET_BITS = 18
#: Rows that are not worth a search by halving.
_FEW = 256


def uniform(seed: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and counter only."""
    counter = np.asarray(counter).astype(np.uint64)
    bits = mix(seed + counter * _STEP) >> np.uint64(11)
    return (bits.astype(np.float64) + 0.5) * 2.0**-53


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``location`` given that they are at most ``most``."""
    return location - np.log(np.exp(location - most) - np.log(u))


class Vocabulary:
    """Pieces of a SentencePiece model with weights and a prefix index.

    The models of this kind have merge ranks, not probabilities. A piece of rank r has the
    log weight -alpha * ln(1 + r); a character without a piece of its own is spelt in byte
    pieces, each as unlikely as the last rank.
    """

    def __init__(self, processor, alpha: float) -> None:
        size = processor.get_piece_size()
        ids = [
            i for i in range(size)
            if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i))
        ]
        names = [processor.id_to_piece(i) for i in ids]
        self.size, self.alpha = size, alpha
        self.byte_ids = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.log_weight = np.zeros(size)
        ranks = np.array([-processor.get_score(i) for i in ids])
        self.log_weight[ids] = -alpha * np.log1p(np.maximum(ranks, 0))
        self.byte_weight = -alpha * np.log1p(size)
        self.longest = max(map(len, names))
        # Every prefix of a piece, with the piece's id or -1.
        table = {name[:k]: -1 for name in names for k in range(1, len(name) + 1)}
        table.update(zip(names, ids))
        hashes = word_hashes(list(table))
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.ids = np.append(np.fromiter(table.values(), np.int64, len(table))[order], -1)
        buckets = np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)
        self.bucket = np.searchsorted(self.hashes, buckets).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in ``hashes``, or -1: from its first bits, then step by step."""
        at = self.bucket[hashes >> np.uint64(64 - _BUCKET_BITS)]
        seen = self.hashes[at]
        low = np.flatnonzero(seen < hashes)
        while len(low):
            at[low] += 1
            seen[low] = self.hashes[at[low]]
            low = low[seen[low] < hashes[low]]
        at[seen != hashes] = -1
        return at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sums(points: np.ndarray) -> np.ndarray:
    return prefix_hash(mix(points.astype(np.uint64) + _STEP))


def word_hashes(words: list[str]) -> np.ndarray:
    length = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(length)
    return span_hash(_sums(_points("".join(words))), stop - length, stop)


class Lattice:
    """Edges of the lattices of ``words``, each with a mark before it, one row per node and one column per piece length.

    Words stand in order of falling length, so the nodes that are as far from the end of
    their word are those of the first words, and what is added up of one distance are
    slices of others. A node is that distance, shifted, and the place of its word; a
    distance of 0 is the end of the word. Rows are as long as the distance, or the longest
    piece; those of one distance lie together. An edge is its place in the rows. Tokens
    from ``vocabulary.size`` on stand for spelt characters.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-length, kind="stable")
        self.shift = len(words).bit_length()
        self.first_node = length << self.shift
        self.first_node[order] |= np.arange(len(words))
        length = length[order]
        points = _points(MARK.join(["", *map(words.__getitem__, order.tolist())]).replace(" ", MARK))
        sums = _sums(points)
        stop = np.cumsum(length)
        word = np.repeat(np.arange(len(words)), length)
        left = stop[word] - np.arange(len(points))
        alive, found = np.arange(len(points)), []
        for size in range(1, vocabulary.longest + 1):
            at = vocabulary.find(span_hash(sums, alive, alive + size))
            known = np.flatnonzero(at >= 0)
            alive, at = alive.take(known), at.take(known)
            if not len(alive) and size > 1:
                break
            found.append((alive, vocabulary.ids.take(at)))
            alive = alive.take(np.flatnonzero(left.take(alive) > size))
        width = len(found)
        # Of each distance: nodes, columns, and the first edge.
        nodes = np.bincount(length, minlength=1)[::-1].cumsum()[::-1]
        self.columns = np.minimum(np.arange(len(nodes)), width)
        ends = np.cumsum(nodes * self.columns)
        self.begin = ends - nodes * self.columns
        edges = int(ends[-1])
        begin = self.begin.take(left) + word * self.columns.take(left)
        self.token = np.full(edges, -1, np.int32)
        for column, (at, token) in enumerate(found):
            self.token[begin.take(at) + column] = token
        spelt = np.flatnonzero(self.token.take(begin) < 0)
        letters, letter = np.unique(points[spelt], return_inverse=True)
        self.token[begin[spelt]] = vocabulary.size + letter
        spelling = [
            vocabulary.byte_ids[list(chr(p).encode("utf-8", "surrogatepass"))] for p in letters
        ]
        # Ids of each spelt character, and log weights; no token is the last of the weights.
        self.size = vocabulary.size
        self.spelt_ids = np.concatenate([np.zeros(0, np.int64), *spelling]).astype(np.int64)
        self.n_spelt = np.array([len(s) for s in spelling], np.int64)
        self.spelt_at = np.cumsum(self.n_spelt) - self.n_spelt
        spelt_weight = [vocabulary.byte_weight * len(s) for s in spelling]
        weight = np.concatenate([vocabulary.log_weight, spelt_weight, [-np.inf]])
        self.upto = np.empty(edges, np.float32)
        self.edge_log_p = np.empty(edges)
        # Logs of the total weight from nodes to the end of their word, the nearest distance first.
        totals = deque([np.zeros(len(words))], max(width, 1))
        for n, columns, first in zip(nodes[1:].tolist(), self.columns[1:].tolist(), self.begin[1:].tolist()):
            part = slice(first, first + n * columns)
            # In double precision: the only edge of a node must have probability 1 exactly.
            values = weight.take(self.token[part].reshape(n, columns).T)
            for value, total in zip(values, totals):
                value += total[:n]
            most = values.max(axis=0)
            share = values - most
            np.exp(share, out=share)
            upto = share.cumsum(axis=0, out=share)
            summed = upto[-1].copy()
            total = most + np.log(summed)
            totals.appendleft(total)
            upto /= summed
            # From the last piece on, nothing may fall through by rounding.
            np.putmask(upto, upto >= 1.0, 2.0)
            values -= total
            self.upto[part].reshape(n, columns)[...] = upto.T
            self.edge_log_p[part].reshape(n, columns)[...] = np.minimum(values, 0, out=values).T
        # All columns, and the steps that find one by halving.
        self.span = np.arange(max(width, 1))
        self.steps = [1 << k for k in reversed(range(max(width - 1, 0).bit_length()))]

    def _places(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance, word and column of edges."""
        left = np.searchsorted(self.begin, edges, "right") - 1
        word, column = np.divmod(edges - self.begin.take(left), self.columns.take(left))
        return left, word, column

    def node_of(self, edges: np.ndarray) -> np.ndarray:
        left, word, _ = self._places(edges)
        return (left << self.shift) + word

    def after(self, edges: np.ndarray) -> np.ndarray:
        left, word, column = self._places(edges)
        return ((left - column - 1) << self.shift) + word

    def is_end(self, nodes: np.ndarray) -> np.ndarray:
        return nodes >> self.shift == 0

    def log_p(self, edges: np.ndarray) -> np.ndarray:
        """Log-probability of each edge at its node."""
        return self.edge_log_p.take(edges)

    def edges_of(self, node: int) -> np.ndarray:
        left, word = node >> self.shift, node & ((1 << self.shift) - 1)
        own = np.arange(self.columns[left]) + self.begin[left] + word * self.columns[left]
        return own[self.token[own] >= 0]

    def _first_above(self, u: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first edge of each row begin..last whose share, with those before it, is above u."""
        if len(u) < _FEW:
            places = np.minimum(begin[:, None] + self.span, last[:, None])
            return begin + (self.upto.take(places) > u[:, None]).argmax(axis=1)
        edge = begin.copy()
        for step in self.steps:
            probe = edge + (step - 1)
            np.minimum(probe, last, out=probe)
            edge += (self.upto.take(probe) <= u) * step
        return edge

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one sampled path from each node to the end of its word; path lengths."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(nodes), np.int64)
        active = np.flatnonzero(~self.is_end(nodes))
        left, seed = nodes.take(active), seeds.take(active)
        word = left & ((1 << self.shift) - 1)
        left >>= self.shift
        while len(active):
            u = uniform(seed, len(steps)).astype(np.float32)
            columns = self.columns.take(left)
            begin = word * columns
            begin += self.begin.take(left)
            edge = self._first_above(u, begin, begin + columns - 1)
            steps.append((active, edge))
            left = left - (edge - begin) - 1
            going = np.flatnonzero(left)
            if len(going) < len(active):
                counts[active] = len(steps)
                active, word, left, seed = (x.take(going) for x in (active, word, left, seed))
        begins = np.cumsum(counts) - counts
        edges = np.zeros(int(counts.sum()), np.int64)
        for k, (paths, edge) in enumerate(steps):
            edges[begins.take(paths) + k] = edge
        return edges, counts

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and the number of ids of each edge."""
        ids = self.token.take(edges).astype(np.int64)
        sizes = np.ones(len(ids), np.int64)
        spelt = np.flatnonzero(ids >= self.size)
        letter = ids[spelt] - self.size
        n = sizes[spelt] = self.n_spelt[letter]
        if len(spelt):
            first = spelt + np.cumsum(n) - n - np.arange(len(spelt))
            ids = np.repeat(ids, sizes)
            ids[ragged(first, n)] = self.spelt_ids[ragged(self.spelt_at[letter], n)]
        return ids, sizes
