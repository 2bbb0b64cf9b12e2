"""A causal self-attention language model in numpy, with a Huffman-coded output.

Tokens stand in blocks; a token attends to those before it in its own block and to the
whole block before, so windows of two blocks overlap by one and each token is scored
once. The output is a binary tree over the vocabulary, so a token's probability takes a
few inner products, and the probabilities of all tokens sum to 1.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Tokens of a block.
BLOCK = 16
#: Inner nodes nearest the root, seven in ten of all steps on paths, whose products with a batch's tokens are one matrix product.
TOP = 63
_OFF = np.float32(-1e9)


@dataclass
class Tree:
    """The path from the root to each token: inner nodes, and the side taken at each."""

    start: np.ndarray
    node: np.ndarray
    side: np.ndarray  # 1 or -1
    bias: np.ndarray  # what makes each side as likely as its counts say

    @staticmethod
    def build(counts: np.ndarray) -> Tree:
        n = len(counts)
        weight = np.concatenate([counts.astype(float) + 0.1, np.zeros(n - 1)])
        parent, sign = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        heap = [(w, i) for i, w in enumerate(weight[:n].tolist())]
        heapq.heapify(heap)
        bias = np.zeros(max(n - 1, 1), np.float32)
        for k in range(n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[i, j]], sign[[i, j]] = n + k, (1, -1)
            bias[k] = np.log(a / b)
            heapq.heappush(heap, (a + b, n + k))
        paths, sides = [], []
        root = 2 * n - 2
        for i in range(n):
            path, side = [], []
            while i != root:
                side.append(sign[i])
                i = int(parent[i])
                path.append(i - n)
            paths.append(path)
            sides.append(side)
        length = np.array([len(p) for p in paths])
        flat = lambda x, kind: np.array([v for row in x for v in row], kind)
        return Tree(np.append(0, np.cumsum(length)), flat(paths, np.int32), flat(sides, np.int8), bias)

    def paths(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides of all tokens' paths end to end, and the length of each."""
        length = self.start[tokens + 1] - self.start[tokens]
        ends = np.cumsum(length)
        at = np.repeat(self.start[tokens] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return self.node.take(at, mode="clip"), self.side.take(at, mode="clip").astype(np.float32), length


def new_params(size: int, bias: np.ndarray, dim: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(dim)).astype(np.float32)
    return {"embed": 0.5 * draw(size, dim), "query": draw(dim, dim), "key": draw(dim, dim), "value": draw(dim, dim), "out": draw(dim, dim), "near": np.zeros(2 * BLOCK, np.float32), "node": np.zeros((max(size - 1, 1), dim), np.float32), "bias": bias.astype(np.float32).copy()}


def blocks_of(tokens: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: inputs (end, tokens) in blocks with the block before, targets (tokens, end), and the text of each block.

    Absent places hold -1: those before a text's first block and after its last token.
    """
    length = np.diff(offsets) + 1
    n_blocks = -(-length // BLOCK)
    of = np.repeat(np.arange(len(length)), n_blocks)
    first = np.cumsum(n_blocks) - n_blocks
    nth = np.arange(len(of)) - first[of]
    place = nth[:, None] * BLOCK + np.arange(BLOCK)  # in its text
    there = place < length[of][:, None]
    padded = np.append(tokens.astype(np.int64), end)
    at = offsets[:-1][of][:, None] + place
    target = np.where(there, np.where(place < length[of][:, None] - 1, padded[np.minimum(at, len(tokens))], end), -1)
    current = np.where(there, np.where(place > 0, padded[np.clip(at - 1, 0, len(tokens))], end), -1)
    before = np.full_like(current, -1)
    before[1:] = current[:-1]
    before[nth == 0] = -1
    return np.concatenate([before, current], 1), target, of, nth


def _masks() -> tuple[np.ndarray, np.ndarray]:
    distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
    return np.where(distance >= 0, distance, 0), np.where(distance >= 0, np.float32(0), _OFF)


_DISTANCE, _CAUSAL = _masks()


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product and not one a block."""
    return (x.reshape(-1, x.shape[2]) @ w).reshape(*x.shape[:2], w.shape[1])


def _at(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """rows[index], in a fourth of its time since numbers aren't checked; those below 0 read row 0."""
    return rows.take(index, 0, mode="clip")


def _flat_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of outer products of the rows of all blocks."""
    return x.reshape(-1, x.shape[2]).T @ y.reshape(-1, y.shape[2])


def _attend(p: dict[str, np.ndarray], inputs: np.ndarray) -> tuple:
    x = _at(p["embed"], inputs)
    own = x[:, BLOCK:]
    q, k, v = _times(own, p["query"]), _times(x, p["key"]), _times(x, p["value"])
    scale = x.dtype.type(1 / np.sqrt(x.shape[2]))
    s = (q * scale) @ k.transpose(0, 2, 1)
    s += p["near"][_DISTANCE] + _CAUSAL
    absent = np.flatnonzero((inputs < 0).any(1))
    s[absent] += np.where(inputs[absent] < 0, _OFF, np.float32(0))[:, None, :]
    if s.max(initial=0) > 40:  # else exp() stays finite as it is
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    a = s @ v
    total = s @ np.ones(2 * BLOCK, s.dtype)
    # a place after the last token may see nothing but itself, which is absent
    total[total == 0] = 1
    a /= total[:, :, None]
    return x, own, q, k, v, scale, s, total, a, own + _times(a, p["out"])


class _Steps:
    """The steps on the paths of tokens end to end: their logits from the tokens' states, and the gradients of both sides."""

    def __init__(self, p: dict[str, np.ndarray], tree: Tree, tokens: np.ndarray, state: np.ndarray):
        node, side, self.length = tree.paths(tokens)
        self.state, self.side, self.size = state, side, len(p["node"])
        self.first = max(self.size - TOP, 0)  # a node's number is above those of all nodes below it
        # column 0 takes the steps on other nodes, without effect
        self.top = np.concatenate([np.zeros((1, state.shape[1]), state.dtype), p["node"][self.first :]])
        self.column = np.maximum(node - (self.first - 1), 0)
        width = len(self.top)
        self.at = np.repeat(np.arange(0, len(tokens) * width, width), self.length)
        self.at += self.column
        self.z = _at((state @ self.top.T).ravel(), self.at)
        self.z += _at(p["bias"], node)
        self.others = np.flatnonzero(node < self.first)
        self.of, self.node = self.at[self.others] // width, node[self.others]
        self.rows, self.vectors = _at(state, self.of), _at(p["node"], self.node)
        self.z[self.others] += np.einsum("ij,ij->i", self.vectors, self.rows)
        self.z *= side

    def back(self, dz: np.ndarray) -> tuple[np.ndarray, dict]:
        """Gradients of the states, and of the nodes and biases with how often each was met, from those of the logits."""
        by_token = np.zeros((len(self.state), len(self.top)), self.state.dtype)
        by_token.ravel()[self.at] = dz
        dh = by_token @ self.top
        own = dz[self.others]
        self.vectors *= own[:, None]
        start = np.flatnonzero(np.append(-1, self.of[:-1]) != self.of)
        dh[self.of[start]] += _run_sums(self.vectors, start)
        self.rows *= own[:, None]
        order, node, first, count = _runs(self.node, self.size)
        rows, bias = _run_sums(_at(self.rows, order), first), np.add.reduceat(own[order], first) if len(own) else own
        node = np.concatenate([node, np.arange(self.first, self.size)])
        count = np.concatenate([count, np.bincount(self.column, minlength=len(self.top))[1:]])
        bias = np.concatenate([bias, (np.ones(len(dh), dh.dtype) @ by_token)[1:]])
        return dh, {"node": (node, np.concatenate([rows, (self.state.T @ by_token).T[1:]]), count), "bias": (node, bias[:, None], count)}


def log_prob(p: dict[str, np.ndarray], tree: Tree, inputs: np.ndarray, target: np.ndarray, batch: int = 256) -> np.ndarray:
    """Natural log probability of each block's targets."""
    out = np.zeros(len(inputs))
    for i in range(0, len(inputs), batch):
        goal = target[i : i + batch]
        there = goal >= 0
        own = _attend(p, inputs[i : i + batch])[-1][there]
        steps = _Steps(p, tree, goal[there], own)
        z, length = steps.z, steps.length
        start = np.cumsum(length) - length
        if z.min(initial=0) > -12:  # a path's probability is the product of its sides', which stays within a double
            np.exp(-z, out=z)
            z += 1
            token = np.log(np.multiply.reduceat(z, start, dtype=np.float64))
        else:
            token = np.add.reduceat(np.logaddexp(0, -z.astype(np.float64)), start)
        out[i : i + batch] = -np.bincount(np.nonzero(there)[0], token, len(goal))
    return out


def _runs(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts indices below `size`, the distinct ones, where each starts in it, and how many there are."""
    index = index.astype(np.uint16 if size <= 1 << 16 else np.uint32)  # 16 bits are sorted by counting
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.zeros(0, np.int64)
    return order, index[first].astype(np.int64), first, np.diff(np.append(first, len(index)))


def _run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at `first`; pairs of numbers are added as complex ones, which takes half the steps."""
    if not len(first):
        return rows[:0]
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, first, 0)
    return np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), first, 0).view(rows.dtype)


class Trainer:
    """Adagrad on blocks of tokens; keeps how often each row was seen."""

    def __init__(self, params: dict[str, np.ndarray], tree: Tree, rate: float = 0.08):
        self.p, self.tree, self.rate = {k: v.copy() for k, v in params.items()}, tree, rate
        self.sum = {k: np.full(v.shape[:1] if k in ("embed", "node", "bias") else v.shape, 1e-6, np.float32) for k, v in params.items()}
        self.seen = {k: np.zeros(len(params[k]), np.float32) for k in ("embed", "node", "bias")}
        self.tokens = 0

    def gradients(self, inputs: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        p = self.p
        x, own, q, k, v, scale, s, total, a, h = _attend(p, inputs)
        s /= total[:, :, None]
        there = target >= 0
        n = max(int(there.sum()), 1)
        steps = _Steps(p, self.tree, target[there], h[there])
        z = np.clip(steps.z, -30, 30)
        loss = -float(z.sum(dtype=np.float64))
        np.exp(z, out=z)
        z += 1
        loss += float(np.log(z).sum(dtype=np.float64))
        dh = np.zeros_like(h)
        dh[there], g = steps.back(-steps.side / z)
        da = _times(dh, p["out"].T)
        g["out"] = _flat_product(a, dh)
        ds = da @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ da
        ds -= np.einsum("ijk,ijk->ij", ds, s)[:, :, None]
        ds *= s  # 0 at places that aren't seen
        g["near"] = np.bincount(_DISTANCE.ravel(), (np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)), 2 * BLOCK).astype(np.float32)
        dq = ds @ k * scale
        dk = ds.transpose(0, 2, 1) @ (q * scale)
        g["query"] = _flat_product(own, dq)
        g["key"], g["value"] = _flat_product(x, dk), _flat_product(x, dv)
        dx = _times(dk, p["key"].T) + _times(dv, p["value"].T)
        dx[:, BLOCK:] += _times(dq, p["query"].T) + dh
        real = np.flatnonzero(inputs >= 0)
        order, at, first, count = _runs(inputs.ravel()[real], len(p["embed"]))
        g["embed"] = at, _run_sums(_at(dx.reshape(-1, dx.shape[2]), real[order]), first), count
        return loss / n, g

    def step(self, inputs: np.ndarray, target: np.ndarray) -> float:
        loss, g = self.gradients(inputs, target)
        n = max(int((target >= 0).sum()), 1)
        self.tokens += n
        for name, grad in g.items():
            if isinstance(grad, tuple):
                at, rows, count = grad
                total = self.sum[name][at] + np.einsum("ij,ij->i", rows, rows) / np.float32(n * rows.shape[1])
                self.sum[name][at] = total
                rows *= (self.rate / np.sqrt(total * np.float32(n)))[:, None]
                self.p[name][at] = _at(self.p[name], at) - (rows[:, 0] if name == "bias" else rows)
                self.seen[name][at] += count
            else:
                grad = grad / np.float32(n)
                self.sum[name] += grad * grad
                self.p[name] -= 0.25 * self.rate * grad / np.sqrt(self.sum[name])
        return loss

    def learn(self, inputs: np.ndarray, target: np.ndarray, batch: int = 64) -> float:
        """One pass over the blocks; the mean loss of its last quarter."""
        losses = [self.step(inputs[i : i + batch], target[i : i + batch]) for i in range(0, len(inputs), batch)]
        return float(np.mean(losses[-max(1, len(losses) // 4) :])) if losses else 0.0
