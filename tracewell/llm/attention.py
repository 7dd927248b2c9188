"""A small causal self-attention model over subword numbers, in numpy.

One attention layer with a residual feed-forward layer predicts the next number in two steps, its
class and then its place in the class, so no step is wider than the classes.  Numbers beyond the first
NUMBERS, from TAIL on, are behind the last of these, ESCAPE: its probability is dealt out to them by a
class and a place of their own, and each adds a vector of its own to the escape's.  Text is cut into
windows of CONTEXT + SCORED places; neighbours overlap by CONTEXT, and each number is scored once,
in the window where it is among the last SCORED.  Windows are run in batches under one causal mask.
"""

from __future__ import annotations

import math

import numpy as np

CONTEXT, SCORED = 16, 32
WIDTH, HIDDEN = 16, 32
CLASSES = MEMBERS = 32
NUMBERS = CLASSES * MEMBERS
ESCAPE = NUMBERS - 1
START, PAD, TAIL = NUMBERS, NUMBERS + 1, NUMBERS + 2
_NEVER = -60.0  # bias of places that no number has
_PLACES = CONTEXT + SCORED
SMALLEST_BATCH, LARGEST_BATCH = 32, 256  # windows in a step: they grow by four a step
_MASK = np.where(np.arange(_PLACES)[None, :] <= np.arange(SCORED)[:, None] + CONTEXT, 0.0, -1e9).astype(np.float32)
_SCALE = np.float32(WIDTH**-0.5)

SHAPES = {
    "embed": (NUMBERS + 2, WIDTH), "place": (_PLACES, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
    "up": (WIDTH, HIDDEN), "up_b": (HIDDEN,), "down": (HIDDEN, WIDTH), "klass": (WIDTH, CLASSES), "klass_b": (CLASSES,), "member": (CLASSES, WIDTH, MEMBERS), "member_b": (CLASSES, MEMBERS),
}

Weights = dict[str, np.ndarray]
Gradients = dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]  # of a large table the rows touched and their gradients


def shapes(tail: int = 0) -> dict[str, tuple[int, ...]]:
    """The weights' shapes with so many numbers from TAIL on."""
    if not tail:
        return SHAPES
    classes = math.isqrt(tail - 1) + 1
    members = -(-tail // classes)
    return SHAPES | {"own": (tail, WIDTH), "tail_klass": (WIDTH, classes), "tail_klass_b": (classes,), "tail": (classes, WIDTH, members), "tail_b": (classes, members)}


def initial(counts: np.ndarray, seed: int = 3) -> Weights:
    """Random weights; the biases start at the logarithms of the numbers' frequencies, those of TAIL and on after the first NUMBERS."""
    rng = np.random.default_rng(seed)
    counts, rare = counts[:NUMBERS], counts[NUMBERS:] + 0.5
    if len(rare):
        counts = np.append(counts[:ESCAPE], rare.sum())
    w = {k: (rng.standard_normal(s) * (0.02 if k in ("o", "down", "klass", "member") else 0.3 if k in ("embed", "place") else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    w["up_b"][:] = 0
    table = (counts + 0.5).reshape(CLASSES, MEMBERS)
    w["klass_b"][:] = np.log(table.sum(axis=1) / table.sum())
    w["member_b"][:] = np.log(table / table.sum(axis=1, keepdims=True))
    if len(rare):
        w |= {k: np.zeros(s, np.float32) for k, s in shapes(len(rare)).items() if k not in SHAPES}
        table = np.zeros(w["tail_b"].shape)
        table.ravel()[: len(rare)] = rare
        total = table.sum(axis=1)
        w["tail_klass_b"][:] = np.where(total > 0, np.log(np.maximum(total, 0.5) / rare.sum()), _NEVER)
        w["tail_b"][:] = np.where(table > 0, np.log(np.maximum(table, 0.5) / np.maximum(total, 0.5)[:, None]), _NEVER)
    return w


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()]).astype(np.float32)


def unflatten(flat: np.ndarray, tail: int = 0) -> Weights:
    out, at = {}, 0
    for k, s in shapes(tail).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def windows(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, document) of each window; numbers of document d are in first[d]:first[d + 1]."""
    n = np.diff(first)
    per = -(-n // SCORED)
    doc = np.repeat(np.arange(len(n)), per)
    begin = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SCORED
    at = begin[:, None] + np.arange(SCORED)
    inside = at < n[doc][:, None]
    safe = np.minimum(at + first[doc][:, None], max(len(numbers) - 1, 0))
    targets = np.where(inside, numbers[safe] if len(numbers) else PAD, PAD)
    at = begin[:, None] + np.arange(_PLACES) - CONTEXT - 1
    inside = (at >= 0) & (at < n[doc][:, None])
    safe = np.clip(at + first[doc][:, None], 0, max(len(numbers) - 1, 0))
    inputs = np.where(inside, numbers[safe] if len(numbers) else PAD, np.where(at == -1, START, PAD))
    return inputs, targets, doc


def _exp(z: np.ndarray) -> np.ndarray | None:
    """z becomes exp(z) in place; each row's largest entry is taken out, and returned, only if it must be."""
    shift = None
    if z.size and z.max() > 60:
        shift = z.max(axis=-1, keepdims=True)
        z -= shift
    np.exp(z, out=z)
    return shift


def _hidden(w: Weights, inputs: np.ndarray) -> dict[str, np.ndarray]:
    """The states after both layers, and what their gradients need.

    Attention is normalised after the values are summed: a last value of one sums the weights along with them.  Padding is masked
    only in first windows; elsewhere it comes after a text, which is hidden from it anyway.
    """
    rare = np.flatnonzero(inputs.ravel() >= TAIL) if "own" in w else np.zeros(0, np.int64)
    ids = inputs.ravel()
    if len(rare):
        ids = np.minimum(ids, ESCAPE, where=ids >= TAIL, out=ids.copy())
    x = w["embed"].take(ids, axis=0).reshape(*inputs.shape, WIDTH)
    if len(rare):
        x.reshape(-1, WIDTH)[rare] += w["own"][inputs.ravel()[rare] - TAIL]
    x += w["place"]
    flat = x.reshape(-1, WIDTH)
    xq = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, WIDTH)
    q = (xq @ (w["q"] * _SCALE)).reshape(-1, SCORED, WIDTH)
    kv = (flat @ np.concatenate([w["k"], w["v"], np.zeros((WIDTH, 1), x.dtype)], axis=1)).reshape(*inputs.shape, 2 * WIDTH + 1)
    kv[:, :, -1] = 1
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    a += _MASK if a.dtype == np.float32 else _MASK.astype(a.dtype)
    new = np.flatnonzero(inputs[:, 0] == PAD)
    if len(new):
        a[new] += np.where(inputs[new] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
    _exp(a)
    mixed = (a @ v).reshape(-1, WIDTH + 1)
    over = 1 / mixed[:, WIDTH:]
    mixed = mixed[:, :WIDTH] * over
    h1 = xq + mixed @ w["o"]
    up = h1 @ w["up"]
    up += w["up_b"]
    np.maximum(up, 0, out=up)
    return {"x": x, "xq": xq, "q": q, "k": k, "v": v, "a": a, "over": over, "mixed": mixed, "h1": h1, "up": up, "h": h1 + up @ w["down"], "ids": ids, "rare": rare}


def _sums(z: np.ndarray) -> np.ndarray:
    return np.ones(len(z), z.dtype) @ z


def _chosen(z: np.ndarray, at: np.ndarray, gradient: bool) -> np.ndarray:
    """log softmax(z) at one entry of each row; z becomes its gradient's negative: softmax less one there."""
    entry = np.arange(0, z.size, z.shape[1]) + at
    flat = z.ravel()  # a view
    out = flat.take(entry)
    shift = _exp(z)
    total = z @ np.ones(z.shape[1], z.dtype)
    out -= np.log(total)
    if shift is not None:
        out -= shift[:, 0]
    if gradient:
        z *= (1 / total)[:, None]
        flat[entry] -= 1
    return out


def _tail(w: Weights, h: np.ndarray, t: np.ndarray, gradient: bool) -> tuple[np.ndarray, ...]:
    """The logarithm of each tail number's share of the escape; for gradients also (class, dz of class, dz of place, dh)."""
    c, m = np.divmod(t - TAIL, w["tail_b"].shape[1])
    zc = h @ w["tail_klass"] + w["tail_klass_b"]
    out = _chosen(zc, c, gradient)
    order = np.argsort(c, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(c[order]) > 0)) if len(c) else np.zeros(0, np.int64)
    runs = list(zip(edge.tolist(), [*edge[1:].tolist(), len(c)], strict=False))
    hs, z = h.take(order, axis=0), np.empty((len(c), w["tail_b"].shape[1]), h.dtype)
    for lo, hi in runs:
        np.matmul(hs[lo:hi], w["tail"][c[order[lo]]], out=z[lo:hi])
    z += w["tail_b"][c[order]]
    out[order] += _chosen(z, m[order], gradient)
    if not gradient:
        return (out,)
    dh = zc @ w["tail_klass"].T
    for lo, hi in runs:
        dh[order[lo:hi]] += z[lo:hi] @ w["tail"][c[order[lo]]].T
    return out, c[order], hs, zc, z, dh


def _tail_sums(c: np.ndarray, h: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, and the gradients of their tables and biases."""
    order = np.argsort(c, kind="stable")
    c, h, z = c[order], h[order], z[order]
    edge = np.flatnonzero(np.append(True, np.diff(c) > 0)) if len(c) else np.zeros(0, np.int64)
    table = np.empty((len(edge), h.shape[1], z.shape[1]), h.dtype)
    for i, (lo, hi) in enumerate(zip(edge.tolist(), [*edge[1:].tolist(), len(c)], strict=False)):
        np.matmul(h[lo:hi].T, z[lo:hi], out=table[i])
    return c[edge], table, np.add.reduceat(z, edge, axis=0) if len(edge) else z


def _output(w: Weights, h: np.ndarray, t: np.ndarray, gradient: bool) -> tuple:
    """log probabilities of t (ESCAPE for the whole tail) given h; for gradients also those of the two tables and of h."""
    c, m = t // MEMBERS, t % MEMBERS
    zc = h @ w["klass"]
    zc += w["klass_b"]
    out = _chosen(zc, c, gradient).astype(np.float64)
    order = np.argsort(c.astype(np.uint8), kind="stable")
    edge = np.searchsorted(c[order], np.arange(CLASSES + 1)).tolist()
    runs = [(k, edge[k], edge[k + 1]) for k in range(CLASSES) if edge[k] < edge[k + 1]]
    hs, z = h.take(order, axis=0), np.empty((len(c), MEMBERS), h.dtype)
    for k, lo, hi in runs:
        np.matmul(hs[lo:hi], w["member"][k], out=z[lo:hi])
        z[lo:hi] += w["member_b"][k]
    out[order] += _chosen(z, m[order], gradient)
    if not gradient:
        return (out,)
    g = {"klass": h.T @ zc, "klass_b": _sums(zc), "member": np.zeros_like(w["member"]), "member_b": np.zeros_like(w["member_b"])}
    dh, dhs = zc @ w["klass"].T, np.empty_like(hs)
    for k, lo, hi in runs:
        np.matmul(hs[lo:hi].T, z[lo:hi], out=g["member"][k])
        g["member_b"][k] = _sums(z[lo:hi])
        np.matmul(z[lo:hi], w["member"][k].T, out=dhs[lo:hi])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh += dhs.take(back, axis=0)
    return out, g, dh


def log_probabilities(w: Weights, numbers: np.ndarray, first: np.ndarray, batch: int = 128) -> np.ndarray:
    """The natural logarithm of each document's probability."""
    out = np.zeros(len(first) - 1)
    inputs, targets, doc = windows(numbers, first)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # states, tail numbers and documents
    for at in range(0, len(doc), batch):
        t = targets[at : at + batch].ravel()
        h = _hidden(w, inputs[at : at + batch])["h"]
        of = np.repeat(doc[at : at + batch], SCORED)
        if (t == PAD).any():
            use = np.flatnonzero(t != PAD)
            h, t, of = h[use], t[use], of[use]
        if "own" in w:
            rare = np.flatnonzero(t >= TAIL)
            held.append((h[rare], t[rare], of[rare]))
            t = np.where(t < TAIL, t, ESCAPE)
        lp = _output(w, h, t, False)[0]
        lo = int(of[0]) if len(of) else 0
        some = np.bincount(of - lo, weights=lp)
        out[lo : lo + len(some)] += some
        if held and (at + batch >= len(doc) or sum(len(x) for _, x, _ in held) > 20000):
            hs, ts, ds = (np.concatenate(x) for x in zip(*held, strict=True))
            np.add.at(out, ds, _tail(w, hs, ts, False)[0])
            held.clear()
    return out


def _summed_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")  # short integers are sorted by radix
    ids = ids[order]
    edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[edge], np.add.reduceat(x.take(order, axis=0), edge, axis=0) if len(ids) else x


def _gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, Gradients, tuple[np.ndarray, ...]]:
    """Mean negative log probability and its gradients, but of the tail's places only (class, state, dz) of each tail number."""
    f = _hidden(w, inputs)
    t = targets.ravel()
    h, use = f["h"], None
    if (t == PAD).any():
        use = np.flatnonzero(t != PAD)
        h, t = h[use], t[use]
    n = max(len(t), 1)
    tail: tuple[np.ndarray, ...] = ()
    loss = 0.0
    g: Gradients = {}
    if "own" in w:
        rare = np.flatnonzero(t >= TAIL)
        lp, c, hs, zc, z, tail_dh = _tail(w, h[rare], t[rare], True)
        loss, tail = -lp.sum(), (c, hs, z / n)
        g |= {"tail_klass": h[rare].T @ zc / n, "tail_klass_b": zc.sum(axis=0) / n}
        t = np.where(t < TAIL, t, ESCAPE)
    lp, out, dh = _output(w, h, t, True)
    loss -= lp.sum()
    g |= {k: x / n for k, x in out.items()}
    if "own" in w:
        dh[rare] += tail_dh
    dh /= n
    if use is not None:
        dh, some = np.zeros_like(f["h"]), dh
        dh[use] = some
    g["down"] = f["up"].T @ dh
    dup = dh @ w["down"].T
    dup *= f["up"] > 0
    g["up"], g["up_b"] = f["h1"].T @ dup, _sums(dup)
    dh1 = dh + dup @ w["up"].T
    g["o"] = f["mixed"].T @ dh1
    dm = np.empty((len(dh1), WIDTH + 1), dh1.dtype)  # by the summed values; the last column takes each row's mean out
    np.matmul(dh1, w["o"].T, out=dm[:, :WIDTH])
    dm[:, WIDTH] = -np.einsum("ij,ij->i", dm[:, :WIDTH], f["mixed"])
    dm *= f["over"]
    dm = dm.reshape(-1, SCORED, WIDTH + 1)
    dkv = np.empty((*inputs.shape, 2 * WIDTH), dm.dtype)
    np.matmul(f["a"].transpose(0, 2, 1), dm[:, :, :WIDTH], out=dkv[:, :, WIDTH:])
    ds = dm @ f["v"].transpose(0, 2, 1)
    ds *= f["a"]
    dq = (ds @ f["k"]).reshape(-1, WIDTH) * _SCALE
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=dkv[:, :, :WIDTH])
    flat, dkv = f["x"].reshape(-1, WIDTH), dkv.reshape(-1, 2 * WIDTH)
    g["q"], of_kv = f["xq"].T @ dq, flat.T @ dkv
    g["k"], g["v"] = of_kv[:, :WIDTH], of_kv[:, WIDTH:]
    dx = (dkv @ np.concatenate([w["k"], w["v"]], axis=1).T).reshape(f["x"].shape)
    dx[:, CONTEXT:] += (dq @ w["q"].T + dh1).reshape(-1, SCORED, WIDTH)
    g["place"] = dx.sum(axis=0)
    dx = dx.reshape(-1, WIDTH)
    if "own" in w:
        g["own"] = _summed_rows(inputs.ravel()[f["rare"]] - TAIL, dx[f["rare"]])
    rows, sums = _summed_rows(f["ids"], dx)
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][rows] = sums
    g["embed"][PAD] = 0
    return float(loss) / n, g, tail


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, Gradients]:
    """Mean negative log probability of the targets of some windows, and its gradients."""
    loss, g, tail = _gradients(w, inputs, targets)
    if tail:
        classes, table, bias = _tail_sums(*tail)
        g["tail"], g["tail_b"] = (classes, table), (classes, bias)
    return loss, g


class Trainer:
    """Adam over the windows of one lot of texts after the other, each in a seeded order; its moments are kept from lot to lot.

    The tail's places take one step a lot, for all of its tail numbers: they are too many for a step with each batch.
    """

    def __init__(self, w: Weights, rate: float, seed: int) -> None:
        self.w = {k: x.copy() for k, x in w.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        self.rate, self.rng, self.step, self.lots, self.seen = rate, np.random.default_rng(seed), 0, 0, 0

    def learn(self, numbers: np.ndarray, first: np.ndarray) -> None:
        inputs, targets, _ = windows(numbers, first)
        order = self.rng.permutation(len(inputs))
        at, tails = 0, []
        while at < len(order):
            of = order[at : at + min(LARGEST_BATCH, SMALLEST_BATCH + 4 * self.step)]
            at += len(of)
            _, g, tail = _gradients(self.w, inputs[of], targets[of])
            self.step += 1
            self._adam(g, self.step)
            if tail and len(tail[0]):
                tails.append(tail)
        if tails:
            self.lots += 1
            classes, table, bias = _tail_sums(*(np.concatenate(x) for x in zip(*tails, strict=True)))
            self._adam({"tail": (classes, table), "tail_b": (classes, bias)}, self.lots)
        self.seen += len(numbers)

    def _adam(self, g: Gradients, step: int) -> None:
        down, across = 1 - 0.9**step, 1 - 0.99**step
        for k, x in g.items():
            w, m, v = self.w[k], self.m[k], self.v[k]
            rows, x = x if isinstance(x, tuple) else (..., x)  # untouched rows of a large table stand still
            m[rows] += 0.1 * (x - m[rows])
            v[rows] += 0.01 * (x * x - v[rows])
            w[rows] -= self.rate * (m[rows] / down) / (np.sqrt(v[rows] / across) + 1e-8)
