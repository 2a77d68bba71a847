"""A linear chain of two labels as a conditional random field in numpy.

A chain's forward and backward messages are ratios of the two labels' values, and a step
along the chain is a fractional linear map of the ratio. So many chains, laid end to end,
are walked as one: it is cut into runs, the maps of each run are multiplied, which gives the
ratio before every run, and then all runs are walked side by side.
"""

from __future__ import annotations

import numpy as np

#: Scores are held within this, steps after which products are scaled, tokens walked at once.
REACH, SCALED, WINDOW = 20.0, 8, 1 << 20
#: Of training: full passes, the step of Adam, the pull of the weights to zero.
PASSES, STEP, RIDGE = 60, 0.2, 0.1


class Field:
    """Scores of label 1 against 0: of each kind of token, of the first token, of each pair of labels against (0, 0)."""

    def __init__(self, kinds: np.ndarray, begin: float = 0.0, pairs=(0.0, 0.0, 0.0)):
        self.kinds, self.begin, self.pairs = kinds, begin, np.asarray(pairs, float)

    def weights(self) -> tuple[float, float, float]:
        return tuple(np.exp(np.clip(self.pairs, -REACH, REACH)))


def ratios(q: np.ndarray, p: np.ndarray, s: np.ndarray, r: np.ndarray, first: float) -> np.ndarray:
    """y[t] = (q[t] y[t-1] + p[t]) / (s[t] y[t-1] + r[t]), where y[-1] is ``first``."""
    n = len(q)
    steps = int(np.ceil(np.sqrt(n)))
    runs = -(-n // steps)
    rest = runs * steps - n
    laid = lambda x, fill: np.ascontiguousarray(np.concatenate((x, np.full(rest, fill))).reshape(runs, steps).T)
    q, p, s, r = laid(q, 1.0), laid(p, 0.0), laid(s, 0.0), laid(r, 1.0)
    a, b, c, d = q[0], p[0], s[0], r[0]
    for t in range(1, steps):
        a, b, c, d = q[t] * a + p[t] * c, q[t] * b + p[t] * d, s[t] * a + r[t] * c, s[t] * b + r[t] * d
        if t % SCALED == 0:
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
    y, before = np.empty(runs), first
    for k in range(runs):
        y[k] = before
        before = (a[k] * before + b[k]) / (c[k] * before + d[k])
    out = np.empty((steps, runs))
    for t in range(steps):
        y = (q[t] * y + p[t]) / (s[t] * y + r[t])
        out[t] = y
    return out.T.ravel()[:n]


def messages(field: Field, kinds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios of the chains that begin at the tokens ``begins``, laid end to end in ``kinds``."""
    n = len(kinds)
    first = np.zeros(n, bool)
    first[begins] = True
    last = np.append(first[1:], True)
    own = np.exp(np.clip(field.kinds, -REACH, REACH))
    begin = np.exp(np.clip(field.begin, -REACH, REACH))
    w01, w10, w11 = field.weights()
    forward, backward = np.empty(n), np.empty(n)
    before = 1.0
    for at in range(0, n, WINDOW):
        x, new = own[kinds[at : at + WINDOW]], first[at : at + WINDOW]
        y = ratios(np.where(new, 0.0, x * w11), np.where(new, x * begin, x * w01), np.where(new, 0.0, w10), np.ones(len(x)), before)
        forward[at : at + WINDOW], before = y, y[-1]
    after = 1.0
    for end in range(n, 0, -WINDOW):
        at = max(0, end - WINDOW)
        x = np.append(own[kinds[at + 1 : end]], own[kinds[end]] if end < n else 1.0)
        done = last[at:end]
        y = ratios(np.where(done, 0.0, x * w11)[::-1], np.where(done, 1.0, w10)[::-1], np.where(done, 0.0, x * w01)[::-1], np.ones(end - at), after)
        backward[at:end], after = y[::-1], y[-1]
    return forward, backward


def marginals(field: Field, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each token."""
    if not len(kinds):
        return np.zeros(0)
    forward, backward = messages(field, kinds, begins)
    both = forward * backward
    return both / (1 + both)


def slopes(field: Field, kinds: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the log-likelihood of ``labels`` by the scores of the kinds, of the begin and of the pairs (0, 1), (1, 0), (1, 1)."""
    forward, backward = messages(field, kinds, begins)
    p = forward * backward / (1 + forward * backward)
    missing = labels - p
    by_kind = np.bincount(kinds, missing, minlength=len(field.kinds))
    inner = np.ones(len(kinds), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    a = forward[at - 1]
    w = np.exp(np.clip(field.kinds, -REACH, REACH))[kinds[at]] * backward[at]
    w01, w10, w11 = field.weights()
    each = np.stack((w01 * w, w10 * a, w11 * a * w))
    expected = (each / (1 + each.sum(0))).sum(1)
    u, v = labels[at - 1], labels[at]
    seen = np.array([((1 - u) * v).sum(), (u * (1 - v)).sum(), (u * v).sum()])
    return by_kind, float(missing[begins].sum()), seen - expected


def fit(kinds: np.ndarray, begins: np.ndarray, labels: np.ndarray, chains: list[np.ndarray], passes: int = PASSES) -> Field:
    """The field of labelled chains.

    A kind's score is the sum of the weights of its features ``chains[kind]`` and of one that
    all kinds have. Weights are pulled to zero; begin and pairs too.
    """
    n = 1 + max((int(c.max()) + 1 for c in chains if len(c)), default=0)
    of = np.repeat(np.arange(len(chains)), [len(c) + 1 for c in chains])
    feature = np.concatenate([np.append(c + 1, 0) for c in chains]).astype(np.int64)
    x = np.zeros(n + 4)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    x[0] = np.log(share / (1 - share))
    pull = np.full(len(x), RIDGE)
    pull[0] = 0.0
    mean, square = np.zeros(len(x)), np.zeros(len(x))
    field = lambda: Field(np.bincount(of, x[feature], minlength=len(chains)), x[n], x[n + 1 :])
    for t in range(1, passes + 1 if len(kinds) else 1):
        by_kind, begin, pairs = slopes(field(), kinds, begins, labels)
        g = np.concatenate((np.bincount(feature, by_kind[of], minlength=n), [begin], pairs)) - pull * x
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x += STEP / (1 + t / 20) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return field()
