"""A small dense network in numpy, used inside tasks only.

Inputs are standardised by the training rows; then dense layers with ELU, dropout between the two halves, and two linear layers to x and y. The loss is the
mean Euclidean distance (weighted by row if weights are given), the optimiser Adam or AdamW. Each epoch ends with a pass over the validation rows: the best weights are kept, the
rate is halved after a sixth of the patience without improvement, and training stops after the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Options:
    width: int = 256
    layers: int = 8
    dropout: float = 0.25
    batch: int = 32
    epochs: int = 5000
    patience: int = 100
    rate: float = 1e-3
    algorithm: str = "adam"
    weight_decay: float = 4e-3
    flip_rate: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.algorithm not in ("adam", "adamw"):
            raise ValueError(f"Unsupported optimizer: {self.algorithm}")


@dataclass
class Fitted:
    weights: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    history: list[tuple[int, float, float, float]] = field(default_factory=list)


def shapes(n_inputs: int, o: Options) -> list[tuple[int, int]]:
    sizes = [n_inputs, *[o.width] * o.layers, 2, 2]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def initial(n_inputs: int, o: Options) -> list[np.ndarray]:
    """Uniform weights within sqrt(6 / (fan in + fan out)), no biases."""
    rng = np.random.default_rng(o.seed)
    out = []
    for a, b in shapes(n_inputs, o):
        edge = np.sqrt(6 / (a + b))
        out += [rng.uniform(-edge, edge, (a, b)).astype(np.float32), np.zeros(b, np.float32)]
    return out


def elu(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))


def elu_slope(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, 1, np.exp(np.minimum(z, 0)))


def forward(weights: list[np.ndarray], x: np.ndarray, o: Options, rng: np.random.Generator | None = None, first: int = 0):
    """Outputs, and what backward() needs. With rng (anything that has random(shape)), dropout is on. weights: those from the layer first on, whose input x is."""
    a, kept = x, []
    for k in range(first, o.layers + 2):
        keep = None
        if k == max(first, o.layers // 2) and rng is not None and o.dropout > 0:
            keep = (rng.random(a.shape) >= o.dropout).astype(np.float32) / (1 - o.dropout)
            a = a * keep
        z = a @ weights[2 * (k - first)] + weights[2 * (k - first) + 1]
        kept.append((a, z, keep))
        a = elu(z) if k < o.layers else z
    return a, kept


def backward(weights: list[np.ndarray], kept, grad: np.ndarray, o: Options, first: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """The gradients of the weights from the layer first on, and that of its input."""
    out: list[np.ndarray] = [None] * len(weights)
    for k in range(o.layers + 1 - first, -1, -1):
        a, z, keep = kept[k]
        if k + first < o.layers:
            grad = grad * elu_slope(z)
        out[2 * k], out[2 * k + 1] = a.T @ grad, grad.sum(axis=0)
        if k or first:
            grad = grad @ weights[2 * k].T
            if keep is not None:
                grad = grad * keep
    return out, grad


#: A training loss: from outputs, wanted outputs (both rows x 2, normalised) and weights of the rows, the weighted sum of their losses and its gradient by the outputs.
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def loss_and_gradient(pred: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted sum of distances and its gradient."""
    d = pred - y
    r = np.sqrt((d**2).sum(axis=1) + 1e-12)
    return float((r * w).sum()), (d / r[:, None] * w[:, None]).astype(np.float32)


def checked_loss(loss: Loss, tolerance: float = 1e-3) -> Loss:
    """The loss, if its gradient agrees with differences of its values on drawn outputs; else a ValueError."""
    rng = np.random.default_rng(0)
    pred, y, w = rng.normal(size=(6, 2)), rng.normal(size=(6, 2)), rng.uniform(0.5, 2, 6)
    _, grad = loss(pred, y, w)
    if np.shape(grad) != pred.shape:
        raise ValueError("The gradient of a loss has a row and two columns for each output")
    for at in np.ndindex(*pred.shape):
        step = np.zeros_like(pred)
        step[at] = 1e-5
        slope = (loss(pred + step, y, w)[0] - loss(pred - step, y, w)[0]) / 2e-5
        if abs(slope - grad[at]) > tolerance * max(1.0, abs(slope)):
            raise ValueError(f"The gradient of the loss at output {at} is {grad[at]}, its values differ by {slope}")
    return loss


class Adam:
    def __init__(self, weights: list[np.ndarray], o: Options):
        self.o, self.t = o, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for w, g, m, v in zip(weights, grads, self.m, self.v, strict=True):
            if self.o.algorithm == "adamw":
                w -= rate * self.o.weight_decay * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * fix * m / (np.sqrt(v) + 1e-7)


class Control:
    """Best weights, halved rates and the end of training, from the validation loss of each epoch."""

    def __init__(self, o: Options):
        self.o, self.rate, self.best, self.since, self.cut = o, o.rate, np.inf, 0, 0
        self.weights: list[np.ndarray] = []

    def seen(self, loss: float, weights: list[np.ndarray]) -> bool:
        """Whether to go on."""
        if loss < self.best:
            self.best, self.since, self.cut = loss, 0, 0
            self.weights = [w.copy() for w in weights]
            return True
        self.since, self.cut = self.since + 1, self.cut + 1
        if self.cut >= max(1, self.o.patience // 6):
            self.rate, self.cut = self.rate / 2, 0
        return self.since < self.o.patience


#: Rows that are scaled to floats at once; of training rows these are a batch.
PIECE = 8192


def input_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each input. Sums of pieces of rows, so no second copy of x is made."""
    one, two = (np.zeros(x.shape[1]) for _ in range(2))
    for at in range(0, len(x), PIECE):
        rows = x[at : at + PIECE].astype(np.float64)
        one += rows.sum(axis=0)
        two += (rows * rows).sum(axis=0)
    mean = one / len(x)
    return mean.astype(np.float32), np.sqrt(np.maximum(two / len(x) - mean * mean, 0) + 1e-3).astype(np.float32)


def fit(
    x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, o: Options, w: np.ndarray | None = None,
    start: list[np.ndarray] | None = None, scale: tuple[np.ndarray, np.ndarray] | None = None, last: bool = False,
    score: Callable[[np.ndarray], np.ndarray] | None = None, loss: Loss = loss_and_gradient,
) -> Fitted:
    """Train on dosages x (rows, sites) and normalised coordinates y, watched on xv, yv (the training rows if there are none).

    start: weights to go on from; scale: mean and deviation of the inputs, else those of x; last: return the last weights and do not watch. score: of normalised
    outputs, its mean is added to the validation loss. loss: what training lowers, and validation watches.
    """
    rng = np.random.default_rng(o.seed + 1)
    w = np.ones(len(x), np.float32) if w is None else (w * len(w) / w.sum()).astype(np.float32)
    mean, spread = scale or input_scale(x)
    if not len(xv):
        xv, yv = x, y
    scaled = lambda rows: (rows.astype(np.float32) - mean) / spread
    weights = start or initial(x.shape[1], o)
    adam, control, history = Adam(weights, o), Control(o), []
    for epoch in range(o.epochs):
        total = 0.0
        order = rng.permutation(len(x))
        for at in range(0, len(x), o.batch):
            rows = order[at : at + o.batch]
            batch = x[rows]
            if o.flip_rate:
                batch = np.where(rng.random(batch.shape) < o.flip_rate, 1 - batch, batch)
            pred, kept = forward(weights, scaled(batch), o, rng)
            value, grad = loss(pred, y[rows], w[rows])
            total += value
            adam.step(weights, backward(weights, kept, (grad / len(rows)).astype(np.float32), o)[0], control.rate)
        if last:
            continue
        pred = np.concatenate([forward(weights, scaled(xv[at : at + PIECE]), o)[0] for at in range(0, len(xv), PIECE)])
        val = loss(pred, yv, np.ones(len(yv), np.float32))[0] / len(yv)
        val += float(np.mean(score(pred))) if score else 0.0
        history.append((epoch, total / len(x), val, control.rate))
        if not control.seen(val, weights):
            break
    return Fitted(control.weights or weights, mean, spread, history)


def predict(model: Fitted, x: np.ndarray, o: Options) -> np.ndarray:
    return forward(model.weights, (x.astype(np.float32) - model.mean) / model.spread, o)[0]
