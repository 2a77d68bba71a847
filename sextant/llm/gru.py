"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import numpy as np

CLASSES = 64
CLASS_WORDS = 64
WORDS = CLASSES * CLASS_WORDS
HIDDEN = 16
#: Steps of backpropagation, and of the windows between which the state is carried.
WINDOW = 32
#: Rows of logits worked on at once, so that they stay in the cache.
ROWS = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def initial(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters under which the model is the unigram model of ``counts``, a count for each word id."""
    rng = np.random.default_rng(seed)
    mass = (counts + 0.1).reshape(CLASSES, CLASS_WORDS)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "x": normal(WORDS, 3 * HIDDEN),
        "u": normal(HIDDEN, 3 * HIDDEN),
        "wc": np.zeros((HIDDEN, CLASSES), np.float32),
        "bc": np.log(mass.sum(1) / mass.sum()).astype(np.float32),
        "ww": np.zeros((CLASSES, HIDDEN, CLASS_WORDS), np.float32),
        "bw": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    }


def step(p: dict, inputs: np.ndarray, h: np.ndarray):
    """One recurrent step: the new state, and the gates for backpropagation."""
    x, g = p["x"].take(inputs, axis=0), h @ p["u"]
    k = HIDDEN
    zr = sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), (z, r, n, g[:, 2 * k :], h)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and the classes that occur with where each begins and ends in it."""
    of = (targets // CLASS_WORDS).astype(np.uint8)
    edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=CLASSES)))).tolist()
    return np.argsort(of, kind="stable"), [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


def _log_softmax_at(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    rows = np.arange(len(targets))
    logits -= logits.max()
    own = logits[rows, targets]
    low = own < -60  # where that maximum is far off, the row's own counts
    far = logits[low] - logits[low].max(1, keepdims=True) if low.any() else None
    out = own - np.log(np.maximum(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype), np.finfo(logits.dtype).tiny))
    if far is not None:
        out[low] = far[np.arange(len(far)), targets[low]] - np.log(np.exp(far).sum(1))
    return out


def log_probability(p: dict, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability: of its class, and of the word in the class."""
    order, classes = _by_class(targets)
    h, targets = h.take(order, axis=0), targets[order]
    logs = np.empty(len(targets), h.dtype)
    for c, a, b in classes:
        logs[a:b] = _log_softmax_at(h[a:b] @ p["ww"][c] + p["bw"][c], targets[a:b] % CLASS_WORDS)
    for a in range(0, len(targets), ROWS):
        logs[a : a + ROWS] += _log_softmax_at(h[a : a + ROWS] @ p["wc"] + p["bc"], targets[a : a + ROWS] // CLASS_WORDS)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _errors(logits: np.ndarray, targets: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The slope of the mean over ``n`` of the cross-entropy by each of the logits, in their place, and the sum of it."""
    rows = np.arange(len(targets))
    logits -= logits.max()
    np.exp(logits, out=logits)
    total = np.maximum(logits @ np.ones(logits.shape[1], logits.dtype), np.finfo(logits.dtype).tiny * n * 1e6)
    loss = -float(np.log(np.maximum(logits[rows, targets] / total, 1e-30)).sum())
    logits *= (1 / (n * total))[:, None]
    logits[rows, targets] -= 1 / n
    return logits, loss


def gradients(p: dict, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Of the mean loss over a window (steps, streams) that begins in state ``h``; also the last state and the loss."""
    steps, k, n = inputs.shape[0], HIDDEN, inputs.size
    kept, states = [], []
    for t in range(steps):
        h, gates = step(p, inputs[t], h)
        kept.append(gates)
        states.append(h)
    d, want = {name: np.zeros_like(v) for name, v in p.items()}, targets.reshape(-1)
    order, classes = _by_class(want)
    flat, want, loss = np.concatenate(states).take(order, axis=0), want[order], 0.0
    slopes = np.empty_like(flat)
    for a in range(0, n, ROWS):
        own = flat[a : a + ROWS]
        error, lost = _errors(own @ p["wc"] + p["bc"], want[a : a + ROWS] // CLASS_WORDS, n)
        d["wc"] += own.T @ error
        d["bc"] += error.sum(0)
        slopes[a : a + ROWS] = error @ p["wc"].T
        loss += lost
    for c, a, b in classes:
        error, lost = _errors(flat[a:b] @ p["ww"][c] + p["bw"][c], want[a:b] % CLASS_WORDS, n)
        d["ww"][c], d["bw"][c] = flat[a:b].T @ error, error.sum(0)
        slopes[a:b] += error @ p["ww"][c].T
        loss += lost
    dstates = np.empty_like(flat)
    dstates[order] = slopes
    dstates = dstates.reshape(steps, -1, k)
    z, r, cand, gn, before = (np.stack(x) for x in zip(*kept, strict=True))
    by_cand, by_z, by_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), gn * r * (1 - r)
    back, dx, dg = np.zeros_like(h), np.empty((steps, h.shape[0], 3 * k), h.dtype), np.empty((steps, h.shape[0], 3 * k), h.dtype)
    back_u = np.ascontiguousarray(p["u"].T)
    for t in reversed(range(steps)):
        dh = dstates[t] + back
        da = dh * by_cand[t]
        dg[t, :, :k] = dh * by_z[t]
        dg[t, :, k : 2 * k] = da * by_r[t]
        dg[t, :, 2 * k :] = da * r[t]
        dx[t, :, 2 * k :] = da
        back = dh * z[t] + dg[t] @ back_u
    dx[:, :, : 2 * k] = dg[:, :, : 2 * k]
    d["u"] = before.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
    seen = inputs.reshape(-1).astype(np.uint16)
    order = np.argsort(seen, kind="stable")
    names, first = np.unique(seen[order], return_index=True)
    d["x"][names] = np.add.reduceat(dx.reshape(-1, 3 * k).take(order, axis=0), first, axis=0)
    return d, h, loss / n


def fit(p: dict, tokens: np.ndarray, start: int, streams: int = 512, rate: float = 0.11) -> dict[str, np.ndarray]:
    """``p`` after one pass over ``tokens`` in parallel streams: truncated backpropagation with Adagrad, the state carried on."""
    streams = max(1, min(streams, len(tokens) // (4 * WINDOW)))
    if not len(tokens):
        return p
    size, longer = divmod(len(tokens), streams)  # so many streams have one token more, which trains last
    cut = longer * (size + 1)
    ahead = tokens[:cut].reshape(longer, size + 1)
    grid = np.concatenate((ahead[:, :size], tokens[cut:].reshape(streams - longer, size))).T
    inputs = np.concatenate((np.full((1, streams), start, grid.dtype), grid[:-1]))
    p = {name: v.copy() for name, v in p.items()}
    past = {name: np.full_like(v, 1e-6) for name, v in p.items()}
    h = np.zeros((streams, HIDDEN), np.float32)

    def learn(inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, share: float = 1.0) -> np.ndarray:
        d, h, _ = gradients(p, inputs, targets, h)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in d.values()))
        scale = np.float32(share / max(norm, 1.0))
        for name, g in d.items():
            if scale != 1:
                g *= scale
            past[name] += g * g
            p[name] -= np.float32(rate) * g / np.sqrt(past[name])
        return h

    for at in range(0, size, WINDOW):
        h = learn(inputs[at : at + WINDOW], grid[at : at + WINDOW], h)
    if longer:
        learn(grid[-1:, :longer], ahead[:, size:].T, h[:longer], longer / (streams * WINDOW))
    return p


def score(p: dict, documents: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log probability of each whole document, the state carried across its windows."""
    lengths = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, out = lengths[order], np.zeros(len(documents))
    flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    begin = (np.cumsum(lengths) - lengths)[order]
    h = np.zeros((len(documents), HIDDEN), np.float32)
    states, targets, owners, waiting = [], [], [], 0
    for t in range(int(sizes[0]) if len(sizes) else 0):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        inputs = flat[begin[:active] + t - 1] if t else np.full(active, start)
        new, _ = step(p, inputs, h[:active])
        h[:active] = new
        states.append(new)
        targets.append(flat[begin[:active] + t])
        owners.append(np.arange(active))
        waiting += active
        if waiting >= 1 << 16 or t + 1 == sizes[0]:
            who = np.concatenate(owners)
            out += np.bincount(who, log_probability(p, np.concatenate(states), np.concatenate(targets)), len(documents))
            states, targets, owners, waiting = [], [], [], 0
    back = np.empty_like(out)
    back[order] = out
    return back
