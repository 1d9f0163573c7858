"""A small causal self-attention language model in numpy.

A position is a token of a text; its vector is a trained projection of the features
of its subword ids.  One head of attention with a bias by distance gives the
probabilities of the next token's class, each in its share of :func:`link` over
all classes.  A window's first ``CONTEXT`` positions are read but not scored;
windows overlap by them, and each token is scored once.
"""

from __future__ import annotations

import ctypes
from itertools import accumulate

import numpy as np

#: Window length, positions of it that are context alone, width.
LENGTH, CONTEXT, WIDTH = 40, 8, 16
SCORED = LENGTH - CONTEXT
#: Features of a token: one for each of the most frequent subwords, spectral ones for all, and those of the places before a text's start mark and of the mark.
KNOWN, SPECTRAL = 46, 16
ABSENT, START = KNOWN + SPECTRAL, KNOWN + SPECTRAL + 1
FEATURES = KNOWN + SPECTRAL + 2
#: Output classes: frequent words alone (the end of a text among them), the others in groups.
ALONE, GROUPS = 32, 64
CLASSES = ALONE + GROUPS
#: Windows computed at once: their arrays stay in a core's cache.
BATCH = 64

SHAPES = {"emb": (FEATURES, WIDTH), "wq": (WIDTH, WIDTH), "wkv": (WIDTH, 2 * WIDTH), "far": (LENGTH,), "wo": (WIDTH, WIDTH), "out": (WIDTH + 1, CLASSES)}
_ENDS = list(accumulate(int(np.prod(s)) for s in SHAPES.values()))
_PLACES = [(name, end - int(np.prod(s)), end, s) for (name, s), end in zip(SHAPES.items(), _ENDS, strict=True)]
SIZE = _ENDS[-1]

#: Distance from each scored position back to each place of its window; what lies ahead is not seen.
_BACK = np.arange(CONTEXT, LENGTH)[:, None] - np.arange(LENGTH)[None, :]
_SEEN, _FAR = (_BACK >= 0).astype(np.float32), np.maximum(_BACK, 0)
#: A step of e and the value of 1 in the bits of a single-precision number, and the bits of 2**-60 and 2**60.
_E, _ONE, _LEAST, _MOST = np.float32((1 << 23) / np.log(2)), np.float32(127 << 23), np.float32(67 << 23), np.float32(187 << 23)
_SCALE = np.float32(WIDTH**-0.5)


def keep_memory() -> None:
    """Let this process keep freed blocks up to 64 MB for the next batch instead of asking the system for cleared pages."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-1, 1 << 28)  # what may lie free
        libc.mallopt(-3, 1 << 26)  # the least block with pages of its own


def link(bits: np.ndarray) -> np.ndarray:
    """The exponential, linear between powers of two, of ``z`` given as ``z * _E + _ONE``; changes its argument.

    Attention and classes are shares of this function, so that both add up to one;
    it costs a clip and a cast.
    """
    np.clip(bits, _LEAST, _MOST, out=bits)
    return bits.astype(np.int32).view(np.float32)


def initial(class_share: np.ndarray, seed: int = 5) -> np.ndarray:
    """Start of training: the output knows the classes' shares alone."""
    rng = np.random.default_rng(seed)
    parts = [np.zeros(s) if name in ("out", "far") else rng.normal(0, s[0] ** -0.5, s) for name, s in SHAPES.items()]
    parts[-1][-1] = np.log(class_share)
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in ``flat``; the last row of ``out`` is the bias."""
    return {name: flat[begin:end].reshape(shape) for name, begin, end, shape in _PLACES}


class Model:
    def __init__(self, flat: np.ndarray):
        self.p = unpacked(flat)
        self.bias = (self.p["far"] * _E + _ONE)[_FAR]
        self.out = self.p["out"] * _E
        self.out[-1] += _ONE
        self.wq = self.p["wq"] * (_SCALE * _E)

    def hidden(self, x: np.ndarray, keep: bool = False):
        """Features of the scored positions of windows with position vectors ``x``, a one behind them."""
        p, n = self.p, len(x)
        kv = np.empty((n, LENGTH, 2 * WIDTH + 1), dtype=np.float32)
        kv[:, :, : 2 * WIDTH] = (x.reshape(-1, WIDTH) @ p["wkv"]).reshape(n, LENGTH, 2 * WIDTH)
        kv[:, :, 2 * WIDTH] = 1  # adds up the weights
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        xs = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, WIDTH)
        q = (xs @ self.wq).reshape(n, SCORED, WIDTH)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.bias
        a = link(a)
        a *= _SEEN
        c = np.matmul(a, v).reshape(-1, WIDTH + 1)
        total = c[:, WIDTH:]
        c = c[:, :WIDTH] / total
        h = np.ones((len(xs), WIDTH + 1), dtype=np.float32)
        np.add(xs, c @ p["wo"], out=h[:, :WIDTH])
        if not keep:
            return h
        return h, xs, q, k, v, a, total, c

    def log_probabilities(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs for each place with a target (not below 0), windows in order.

        The probability of the target class, and the classes' mean ``weight`` under their probabilities.
        """
        each = np.stack([np.ones(CLASSES), weight], axis=1).astype(np.float32)
        won, mean = [np.zeros(0, dtype=np.float32)], [np.zeros(0, dtype=np.float32)]
        for at in range(0, len(x), BATCH):
            t = target[at : at + BATCH].ravel()
            there = np.flatnonzero(t >= 0)
            z = link(self.hidden(x[at : at + BATCH]).take(there, axis=0) @ self.out)
            total = z @ each
            log = np.log(total[:, 0])
            won.append(np.log(z[np.arange(len(z)), t[there]]) - log)
            mean.append(np.log(np.maximum(total[:, 1], 1e-30)) - log)
        return np.concatenate(won), np.concatenate(mean)


def gradient(flat: np.ndarray, features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss over the targets that are there (not below 0).

    ``features`` are those of each place of the windows.  The link's slope is taken for its value.
    """
    model, n = Model(flat), len(features)
    p, features = model.p, features.reshape(-1, FEATURES)
    x = (features @ p["emb"]).reshape(n, LENGTH, WIDTH)
    h, xs, q, k, v, a, total, c = model.hidden(x, keep=True)
    t = target.ravel()
    there = t >= 0
    z = link(h @ model.out)
    all_z = z @ np.ones(CLASSES, dtype=np.float32)
    z.reshape(-1)[np.arange(0, z.size, CLASSES) + np.maximum(t, 0)] -= all_z
    share = (there / (all_z * np.float32(max(np.count_nonzero(there), 1))))[:, None]  # each row of z times its share is its slope
    flat_g = np.zeros(SIZE, dtype=np.float32)
    g = unpacked(flat_g)
    g["out"][:] = (z.T @ (h * share)).T
    dh = z @ p["out"][:-1].T
    dh *= share
    g["wo"][:] = c.T @ dh
    dc = np.empty((len(h), WIDTH + 1), dtype=np.float32)  # by the sum of weights; the last column meets that of v
    np.divide(dh @ p["wo"].T, total, out=dc[:, :WIDTH])
    np.negative(np.einsum("rw,rw->r", dc[:, :WIDTH], c), out=dc[:, WIDTH])
    dc = dc.reshape(n, SCORED, WIDTH + 1)
    dkv = np.empty((n, LENGTH, 2 * WIDTH), dtype=np.float32)
    dkv[:, :, WIDTH:] = np.matmul(a.transpose(0, 2, 1), dc[:, :, :WIDTH])
    ds = np.matmul(dc, v.transpose(0, 2, 1))
    ds *= a
    g["far"][:] = np.bincount(_FAR.ravel(), weights=ds.sum(0).ravel(), minlength=LENGTH)
    dq = np.matmul(ds, k).reshape(-1, WIDTH)
    dq *= _SCALE
    q *= np.float32(1 / _E)
    dkv[:, :, :WIDTH] = np.matmul(ds.transpose(0, 2, 1), q)
    dkv = dkv.reshape(-1, 2 * WIDTH)
    g["wkv"][:] = x.reshape(-1, WIDTH).T @ dkv
    g["wq"][:] = xs.T @ dq
    dx = (dkv @ p["wkv"].T).reshape(n, LENGTH, WIDTH)
    dh += dq @ p["wq"].T
    dx[:, CONTEXT:] += dh.reshape(n, SCORED, WIDTH)
    g["emb"][:] = (dx.reshape(-1, WIDTH).T @ features).T
    return flat_g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.m, self.v, self.t = np.zeros(SIZE, dtype=np.float32), np.zeros(SIZE, dtype=np.float32), 0

    def step(self, features: np.ndarray, target: np.ndarray, rate: float) -> None:
        g = gradient(self.flat, features, target)
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        self.flat -= np.float32(rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-8))
