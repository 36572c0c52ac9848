"""Score-aware (anisotropic) quantisation for maximum inner product search, on arrays only.

Vectors are split by a coarse quantiser into cells; what is left of a vector after its cell's centre is coded
by 4-bit codes of two-dimensional subspaces. Coding penalises the residual's part parallel to the vector
``ETA`` times as much as the part orthogonal to it, as only the former changes large inner products much.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SUB = 2  # dimensions of a subspace
CODES = 16  # 4 bits
#: Inner product (of unit vectors) for which the quantiser is tuned.
TUNED_AT = 0.2


def eta(dim: int, at: float = TUNED_AT) -> float:
    """Weight of the parallel error relative to the orthogonal error."""
    return (dim - 1) * at * at / (1 - at * at)


#: Most cells; twice the root of the number of vectors stays below it up to 268 million of them.
MAX_CELLS = 32_768
#: Cells above which k-means works in two levels.
ONE_LEVEL = 2_048


def coarse_cells(n: int) -> int:
    return max(1, min(MAX_CELLS, n, int(2 * np.sqrt(n))))


def cell_centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres: by k-means, above ``ONE_LEVEL`` by k-means within the cells of a first k-means, in proportion to
    their rows, so that the work grows with the root of k."""
    if k <= ONE_LEVEL:
        return spherical_kmeans(x, k)
    first = spherical_kmeans(x, int(np.sqrt(k)))
    home = np.concatenate([(x[a : a + 8192] @ first.T).argmax(1) for a in range(0, len(x), 8192)])
    rows = np.bincount(home, minlength=len(first))
    ends = np.rint(np.cumsum(rows) * (k / len(x))).astype(np.int64)
    share = np.diff(ends, prepend=0)
    parts = [spherical_kmeans(x[home == c], int(share[c])) for c in range(len(first)) if share[c]]
    return np.concatenate(parts)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres; an empty cell is started anew at the worst-served vector."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        best, score = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
        for a in range(0, len(x), 8192):
            s = x[a : a + 8192] @ centres.T
            best[a : a + 8192] = s.argmax(1)
            score[a : a + 8192] = s.max(1)
        order = np.argsort(best, kind="stable")
        begin = np.searchsorted(best[order], np.arange(k + 1))
        cum = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x[order], 0, dtype=np.float64)])
        sums = cum[begin[1:]] - cum[begin[:-1]]
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-9)
        if len(empty):
            sums[empty] = x[np.argsort(score)[: len(empty)]]
            norm[empty] = np.linalg.norm(sums[empty], axis=1)
        centres = (sums / np.maximum(norm, 1e-12)[:, None]).astype(x.dtype)
    return centres


@dataclass
class Model:
    centres: np.ndarray  # cells x dim
    books: np.ndarray  # subspaces x CODES x SUB
    weight: float

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def nearest_cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Cells by inner product with their centre, best first."""
        s = x.astype(np.float32) @ self.centres.T
        p = min(probes, s.shape[1])
        top = np.argpartition(-s, p - 1, axis=1)[:, :p]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """One code per subspace, by coordinate descent on the anisotropic loss."""
        target = (x - self.centres[cell]).reshape(len(x), -1, SUB)
        along = x.reshape(len(x), -1, SUB)
        return _assign(target, along, self.books, self.weight, sweeps)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two 4-bit codes in a byte."""
        return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query and byte position the inner products of all 256 pairs of codes."""
        parts = np.einsum("nsd,scd->nsc", q.reshape(len(q), -1, SUB), self.books, optimize=True).astype(np.float32)
        low, high = parts[:, 0::2], parts[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, CODES * CODES)


def _assign(target: np.ndarray, along: np.ndarray, books: np.ndarray, weight: float, sweeps: int) -> np.ndarray:
    n, subs, _ = target.shape
    codes = np.empty((n, subs), np.uint8)
    part = np.empty((n, subs), target.dtype)  # parallel error of each subspace
    for s in range(subs):
        gap = target[:, s, None, :] - books[s]
        codes[:, s] = (gap**2).sum(2).argmin(1)
        part[:, s] = ((target[:, s] - books[s][codes[:, s]]) * along[:, s]).sum(1)
    total = part.sum(1)
    for _ in range(sweeps):
        for s in range(subs):
            gap = target[:, s, None, :] - books[s]
            rest = (total - part[:, s])[:, None]
            mine = (gap * along[:, s, None, :]).sum(2)
            loss = (gap**2).sum(2) + (weight - 1) * (rest + mine) ** 2
            codes[:, s] = loss.argmin(1)
            new = np.take_along_axis(mine, codes[:, s, None].astype(np.int64), 1)[:, 0]
            total += new - part[:, s]
            part[:, s] = new
    return codes


def train(sample: np.ndarray, cells: int, rounds: int = 5, seed: int = 11, code_rows: int = 8192) -> Model:
    """Fit centres and code books to unit vectors. Books are updated by the exact minimiser of the loss, a small
    weighted least-squares problem per code; they see at most ``code_rows`` evenly spaced rows of the sample."""
    x = sample.astype(np.float32)
    dim = x.shape[1]
    centres = cell_centres(x, cells) if cells > 1 else np.zeros((1, dim), np.float32)
    cell = np.concatenate([(x[a : a + 8192] @ centres.T).argmax(1) for a in range(0, len(x), 8192)]) if cells > 1 else np.zeros(len(x), np.int64)
    pick = slice(None, None, -(-len(x) // code_rows))
    x, cell = x[pick], cell[pick]
    target = (x - centres[cell]).reshape(len(x), -1, SUB)
    along = x.reshape(len(x), -1, SUB)
    subs, rng, w = target.shape[1], np.random.default_rng(seed), eta(dim)
    books = np.stack([target[rng.choice(len(x), CODES, replace=len(x) < CODES), s] for s in range(subs)])
    for _ in range(rounds):
        codes = _assign(target, along, books, w, 1)
        gap = np.stack([target[:, s] - books[s][codes[:, s]] for s in range(subs)], 1)
        part = (gap * along).sum(2)
        total = part.sum(1)
        for s in range(subs):
            a, t = along[:, s], target[:, s]
            rest = total - part[:, s] + (t * a).sum(1)
            for c in range(CODES):
                on = codes[:, s] == c
                if on.any():
                    lhs = on.sum() * np.eye(SUB) + (w - 1) * a[on].T @ a[on]
                    rhs = t[on].sum(0) + (w - 1) * (rest[on, None] * a[on]).sum(0)
                    books[s, c] = np.linalg.solve(lhs, rhs)
    return Model(centres, books.astype(np.float32), w)
