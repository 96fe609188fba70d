"""Exact forward and backward recursions over many chains at once, for CRF and HMM.

All sequences of a batch lie end to end in one (N, K) array of emission weights. They are cut into lanes of at most
``LANE`` positions that are stepped together. A sequence of several lanes first gets each lane's K x K transfer
matrix; a short scan over these gives what enters and leaves every lane, so a very long text costs many lanes,
not many steps, and the result is that of one recursion over the whole text.
"""

from __future__ import annotations

import numpy as np

LANE = 128


class Lanes:
    """Lanes of sequences with these lengths (each at least 1)."""

    def __init__(self, lengths: np.ndarray, lane: int = LANE):
        self.lengths = np.asarray(lengths, np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        per = -(-self.lengths // lane)
        self.owner = np.repeat(np.arange(len(per)), per)
        self.rank = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.start = self.begin[self.owner] + self.rank * lane
        self.size = np.minimum(self.lengths[self.owner] - self.rank * lane, lane)
        self.per = per
        self.first = np.cumsum(per) - per
        self.total = int(self.lengths.sum())


def _steps(size: np.ndarray):
    order = np.argsort(-size, kind="stable")
    down = size[order]
    for t in range(int(down[0]) if len(down) else 0):
        yield t, order[: np.searchsorted(-down, -t, "left")]


def _transfers(e: np.ndarray, a: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, log of what was divided out) of each lane: diag(e1) A diag(e2) ... A diag(en)."""
    k = a.shape[0]
    m, log = np.zeros((len(start), k, k), e.dtype), np.zeros(len(start))
    for t, on in _steps(size):
        w = e[start[on] + t]
        if t == 0:
            x = np.eye(k, dtype=e.dtype)[None] * w[:, None, :]
        else:
            x = (m[on].reshape(-1, k) @ a).reshape(-1, k, k) * w[:, None, :]
        s = x.max((1, 2))
        m[on] = x / s[:, None, None]
        log[on] += np.log(s)
    return m, log


def _enter(lanes: Lanes, e: np.ndarray, a: np.ndarray, init: np.ndarray):
    """What enters each lane (before its first emission), the lanes of long sequences, their matrices, log likelihood of long sequences."""
    prior = np.tile(init.astype(e.dtype), (len(lanes.start), 1))
    long = np.flatnonzero(lanes.per[lanes.owner] > 1)
    m, log = _transfers(e, a, lanes.start[long], lanes.size[long])
    at = np.full(len(lanes.start), -1)
    at[long] = np.arange(len(long))
    total = np.zeros(len(lanes.per))
    for r in range(int(lanes.per.max()) if len(lanes.per) else 0):
        seq = np.flatnonzero((lanes.per > 1) & (lanes.per > r))
        if not len(seq):
            break
        lane = lanes.first[seq] + r
        out = np.einsum("nk,nkj->nj", prior[lane], m[at[lane]])
        s = out.sum(1)
        total[seq] += np.log(s) + log[at[lane]]
        more = lanes.per[seq] > r + 1
        prior[lane[more] + 1] = (out[more] / s[more, None]) @ a
    return prior, at, m, total


def likelihood(e: np.ndarray, a: np.ndarray, init: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log likelihood (or log partition) of each sequence."""
    lanes = Lanes(lengths)
    prior, at, m, total = _enter(lanes, e, a, init)
    short = np.flatnonzero(at < 0)
    p, log, begin, one = prior[short], np.zeros(len(short)), lanes.start[short], np.ones(len(init))
    for t, on in _steps(lanes.size[short]):
        x = p[on] * e[begin[on] + t]
        s = x @ one
        log[on] += np.log(s)
        p[on] = (x / s[:, None]) @ a
    total[lanes.owner[short]] = log
    return total


def forward_backward(e: np.ndarray, a: np.ndarray, init: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each position, expected transitions, log likelihood of each sequence)."""
    lanes = Lanes(lengths, lane)
    k = a.shape[0]
    a, init, one = a.astype(e.dtype), init.astype(e.dtype), np.ones(k, e.dtype)
    prior, at, m, total = _enter(lanes, e, a, init)
    # what leaves each lane backwards: 1 at a sequence's end
    leave = np.ones((len(lanes.start), k), e.dtype)
    for r in range(int(lanes.per.max()) - 1 if len(lanes.per) else 0, 0, -1):
        seq = np.flatnonzero(lanes.per > r)
        lane = lanes.first[seq] + r
        back = np.einsum("nkj,nj->nk", m[at[lane]], leave[lane]) @ a.T
        leave[lane - 1] = back / back.sum(1)[:, None]
    alpha, beta = np.empty((lanes.total, k), e.dtype), np.empty((lanes.total, k), e.dtype)
    p, log = prior, np.zeros(len(lanes.start))
    for t, on in _steps(lanes.size):
        at_t = lanes.start[on] + t
        x = p[on] * e[at_t]
        s = x @ one
        log[on] += np.log(s)
        x /= s[:, None]
        alpha[at_t] = x
        p[on] = x @ a
    b, at_end = leave, lanes.start + lanes.size - 1
    for t, on in _steps(lanes.size):
        at_t = at_end[on] - t
        x = b[on]
        beta[at_t] = x
        x = (x * e[at_t]) @ a.T
        b[on] = x / (x @ one)[:, None]
    single = np.flatnonzero(at < 0)
    total[lanes.owner[single]] = log[single]
    post = alpha * beta
    post /= (post @ one)[:, None]
    inner = np.ones(max(lanes.total - 1, 0), bool)
    inner[lanes.begin[1:] - 1] = False
    v = (e * beta)[1:][inner]
    u = alpha[:-1][inner]
    z = ((u @ a) * v) @ one
    return post, a * ((u / z[:, None]).T @ v), total
