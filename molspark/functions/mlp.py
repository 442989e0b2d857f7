"""Arithmetic of the regression head on numpy blocks, used inside Arrow tasks.

A head is a flat parameter vector: ``layers`` blocks of (d x d weights, d biases) with GELU
after each, then d output weights and one bias. Keeping it flat makes a gradient a row
that Spark can sum.
"""

from __future__ import annotations

import math

import numpy as np

# erf on a grid; between its points six terms of the Taylor series are exact to rounding.
_STEPS, _FAR = 64, 6
_GRID = np.array([math.erf(i / _STEPS) for i in range(_FAR * _STEPS + 1)])


def erf(z: np.ndarray) -> np.ndarray:
    size = np.minimum(np.abs(z), float(_FAR))
    nearest = np.rint(size * _STEPS)
    x = nearest / _STEPS
    d = size - x
    # derivatives of erf are its slope times Hermite polynomials
    hermite = (1.0, -2 * x, 4 * x**2 - 2, -8 * x**3 + 12 * x, 16 * x**4 - 48 * x**2 + 12, -32 * x**5 + 160 * x**3 - 120 * x)
    total = np.zeros_like(d)
    for order in range(len(hermite), 0, -1):
        total = (total + hermite[order - 1]) * d / order
    return np.sign(z) * (_GRID[nearest.astype(int)] + 2 / math.sqrt(math.pi) * np.exp(-x * x) * total)


def n_parameters(d: int, layers: int) -> int:
    return layers * (d * d + d) + d + 1


def init_parameters(d: int, layers: int, seed: int) -> np.ndarray:
    bound = 1.0 / math.sqrt(d)
    return np.random.default_rng(seed).uniform(-bound, bound, n_parameters(d, layers))


def unpack(flat: np.ndarray, d: int, layers: int):
    blocks, at = [], 0
    for _ in range(layers):
        blocks.append((flat[at : at + d * d].reshape(d, d), flat[at + d * d : at + d * d + d]))
        at += d * d + d
    return blocks, flat[at : at + d], flat[at + d]


def _gelu_parts(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact GELU and its derivative."""
    cdf = 0.5 * (1.0 + erf(z / math.sqrt(2.0)))
    pdf = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    return z * cdf, cdf + z * pdf


def predict(flat: np.ndarray, x: np.ndarray, layers: int) -> np.ndarray:
    blocks, w_out, b_out = unpack(flat, x.shape[1], layers)
    for w, b in blocks:
        z = x @ w.T + b
        x = z * 0.5 * (1.0 + erf(z / math.sqrt(2.0)))
    return x @ w_out + b_out


def squared_error_gradient(flat, x, y, layers, dropout=0.0, rng=None):
    """(sum of squared errors, gradient of that sum) over the rows of a block."""
    d = x.shape[1]
    blocks, w_out, b_out = unpack(flat, d, layers)
    saved = []
    for w, b in blocks:
        out, slope = _gelu_parts(x @ w.T + b)
        if dropout > 0.0 and rng is not None:
            mask = (rng.random(out.shape) >= dropout) / (1.0 - dropout)
            out, slope = out * mask, slope * mask
        saved.append((x, slope))
        x = out
    error = x @ w_out + b_out - y
    tail = [(2.0 * error) @ x, [2.0 * error.sum()]]
    back = 2.0 * error[:, None] * w_out[None, :]
    grads = []
    for (w, _), (inputs, slope) in zip(reversed(blocks), reversed(saved)):
        back = back * slope
        grads.append((back.T @ inputs, back.sum(axis=0)))
        back = back @ w
    parts = [p for gw, gb in reversed(grads) for p in (gw.ravel(), gb)]
    return float(error @ error), np.concatenate([*parts, *tail])


def adam_step(flat, m, v, step, gradient, rate, clip=1.0):
    """One Adam update (betas 0.9 and 0.999) with the gradient norm clipped."""
    norm = math.sqrt(float(gradient @ gradient))
    if clip and norm > clip:
        gradient = gradient * (clip / norm)
    m = 0.9 * m + 0.1 * gradient
    v = 0.999 * v + 0.001 * gradient * gradient
    change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return flat - rate * change, m, v


def linear_schedule(step: int, total: int, rate: float, warmup: float) -> float:
    """Learning rate that rises over the warm-up share of steps, then falls to zero."""
    rising = math.ceil(total * warmup)
    if step <= rising:
        return rate * step / max(rising, 1)
    return rate * max(total - step + 1, 0) / max(total - rising, 1)
