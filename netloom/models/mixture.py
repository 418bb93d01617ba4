"""A Gaussian mixture whose weights, means and deviations depend on the input.

Two one-hidden-layer networks read the input: one gives the mixture logits, the other the
means and log deviations.  Everything here is array arithmetic on one block of rows.
"""

from __future__ import annotations

import math

import numpy as np

# Half width of a scored bin, and the floor inside the logarithm.
HALF_BIN = 1.0 / 200 / 2
FLOOR = 1e-10

# erf and its slope at the knots of a cubic interpolation, exact to 1e-12; beyond the last knot it is 1.
_STEPS, _LAST = 512, 6
_KNOTS = np.arange(_LAST * _STEPS + 2) / _STEPS
_AT = np.array([math.erf(k) for k in _KNOTS])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_KNOTS**2) / _STEPS


def _erf(z):
    x = np.minimum(np.abs(z), _LAST) * _STEPS
    i = x.astype(int)
    t = x - i
    u = 1 - t
    value = u * u * ((1 + 2 * t) * _AT[i] + t * _SLOPE[i]) + t * t * ((1 + 2 * u) * _AT[i + 1] - u * _SLOPE[i + 1])
    return np.copysign(value, z)


def shapes(inputs: int, components: int) -> dict[str, tuple]:
    return {
        "gate_w1": (inputs, inputs), "gate_b1": (inputs,),
        "gate_w2": (inputs, components), "gate_b2": (components,),
        "norm_w1": (inputs, inputs), "norm_b1": (inputs,),
        "norm_w2": (inputs, 2 * components), "norm_b2": (2 * components,),
    }


def size(inputs: int, components: int) -> int:
    return sum(math.prod(s) for s in shapes(inputs, components).values())


def initial(inputs: int, components: int, seed: int) -> np.ndarray:
    """Uniform start within one over the root of the fan-in."""
    rng = np.random.default_rng(seed)
    return rng.uniform(-1, 1, size(inputs, components)) / math.sqrt(inputs)


def unpack(flat: np.ndarray, inputs: int, components: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(inputs, components).items():
        n = math.prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def _elu(z):
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))


def _forward(p, x):
    hidden = {}
    heads = {}
    for net in ("gate", "norm"):
        hidden[net] = _elu(x @ p[f"{net}_w1"] + p[f"{net}_b1"])
        heads[net] = hidden[net] @ p[f"{net}_w2"] + p[f"{net}_b2"]
    logits = heads["gate"] - heads["gate"].max(axis=1, keepdims=True)
    weights = np.exp(logits)
    weights /= weights.sum(axis=1, keepdims=True)
    k = weights.shape[1]
    # Deviations are kept finite for any parameters a step may reach.
    log_sd = np.clip(heads["norm"][:, k:], -15.0, 15.0)
    return hidden, weights, heads["norm"][:, :k], log_sd


def mixture(flat: np.ndarray, x: np.ndarray, components: int):
    """Weights, means and deviations of each row."""
    _, weights, mean, log_sd = _forward(unpack(flat, x.shape[1], components), x)
    return weights, mean, np.exp(log_sd)


def _pdf(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _cdf(z):
    return 0.5 * (1.0 + _erf(z / math.sqrt(2)))


def _component_likelihood(y, mean, log_sd, binned):
    """Likelihood of each component with its derivatives by mean and log deviation."""
    sd = np.exp(log_sd)
    if binned:
        hi, lo = (y + HALF_BIN - mean) / sd, (y - HALF_BIN - mean) / sd
        phi_hi, phi_lo = _pdf(hi), _pdf(lo)
        return _cdf(hi) - _cdf(lo), (phi_lo - phi_hi) / sd, phi_lo * lo - phi_hi * hi
    z = (y - mean) / sd
    density = _pdf(z) / sd
    return density, density * z / sd, density * (z * z - 1.0)


def row_loss(flat, x, y, components, binned) -> np.ndarray:
    """Negative log likelihood of each row: of its density, or of its 0.005-wide bin."""
    _, weights, mean, log_sd = _forward(unpack(flat, x.shape[1], components), x)
    like, _, _ = _component_likelihood(y[:, None], mean, log_sd, binned)
    return -np.log((weights * like).sum(axis=1) + FLOOR)


def loss_and_gradient(flat, x, y, components, binned) -> tuple[float, np.ndarray]:
    """Loss and gradient, both summed over the rows."""
    p = unpack(flat, x.shape[1], components)
    hidden, weights, mean, log_sd = _forward(p, x)
    like, by_mean, by_log_sd = _component_likelihood(y[:, None], mean, log_sd, binned)
    share = (weights * like).sum(axis=1, keepdims=True)
    scale = -1.0 / (share + FLOOR)
    inside = (log_sd > -15.0) & (log_sd < 15.0)
    d_head = {
        "gate": scale * weights * (like - share),
        "norm": np.hstack([scale * weights * by_mean, scale * weights * by_log_sd * inside]),
    }
    grad = {}
    for net, d_out in d_head.items():
        h = hidden[net]
        d_hidden = (d_out @ p[f"{net}_w2"].T) * np.where(h > 0, 1.0, h + 1.0)
        grad |= {
            f"{net}_w1": x.T @ d_hidden, f"{net}_b1": d_hidden.sum(axis=0),
            f"{net}_w2": h.T @ d_out, f"{net}_b2": d_out.sum(axis=0),
        }
    flat_grad = np.concatenate([grad[name].ravel() for name in shapes(x.shape[1], components)])
    return float(-np.log(share + FLOOR).sum()), flat_grad
