"""The sequence classifier as numpy: convolutions, LSTM in both directions, attention or last step, two linear layers.

Only what a task does with the rows it is given stands here; how steps are dealt over the cluster is in
``training``. Arrays are steps by channels by rows, so that what is done value by value runs over long
stretches, and parameters one flat vector. Nets that differ in filters, layers and settings alone go through
recurrence and linear layers side by side, by products of their own: a net's numbers don't depend on which others run.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Net:
    """Sizes and settings of one classifier of series of ``width`` values."""

    width: int
    classes: int
    filters: int = 32
    hidden: int = 128
    layers: int = 1
    dense: int = 64
    dropout: float = 0.1
    rate: float = 0.001
    attention: bool = True

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Of every parameter, in the order of the vector."""
        sizes, f, h = {}, self.filters, self.hidden
        for k, (n_in, n_out) in enumerate(((1, f), (f, 2 * f), (2 * f, 4 * f))):
            sizes |= {f"conv{k}": (3 * n_in, n_out), f"conv{k}_bias": (n_out,)}
        for layer in range(self.layers):
            for way in ("ahead", "back"):
                sizes |= {f"{way}{layer}_in": (2 * h if layer else 4 * f, 4 * h), f"{way}{layer}_own": (h, 4 * h), f"{way}{layer}_bias": (4 * h,)}
        if self.attention:
            sizes["attend"] = (2 * h,)
        return sizes | {"dense": (2 * h, self.dense), "dense_bias": (self.dense,), "out": (self.dense, self.classes), "out_bias": (self.classes,)}

    def size(self) -> int:
        return places(self)[-1][-1]

    def parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """Views of a parameter vector by name."""
        return {name: vector[low:high].reshape(shape) for name, shape, low, high in places(self)}

    def alike(self) -> tuple:
        """What nets that run side by side have in common."""
        return self.width, self.classes, self.hidden, self.dense, self.attention

    def drawn(self, seed: int) -> np.ndarray:
        """First parameters: even between plus and minus 1 by the root of the inputs; of a recurrence, of its units."""
        draw = np.random.default_rng(seed)
        vector = np.empty(self.size())
        bound = 1.0
        for name, part in self.parts(vector).items():
            if not name.endswith("_bias"):
                bound = 1 / np.sqrt(self.hidden if name.startswith(("ahead", "back")) else len(part))
            part[...] = draw.uniform(-bound, bound, part.shape)
        return vector


@functools.lru_cache(maxsize=1024)
def places(net: Net) -> list[tuple[str, tuple[int, ...], int, int]]:
    """Name, shape, start and end of every parameter in the vector."""
    out, at = [], 0
    for name, shape in net.shapes().items():
        out.append((name, shape, at, at := at + math.prod(shape)))
    return out


def surroundings(x):
    """Each step with the one before and after, zeros beyond the ends: steps by three times the channels by rows."""
    steps, channels, n = x.shape
    near = np.empty((steps, 3, channels, n))
    near[0, 0], near[-1, 2] = 0, 0
    near[1:, 0], near[:, 1], near[:-1, 2] = x[:-1], x, x[1:]
    return near.reshape(steps, 3 * channels, n)


def convolve(near, w, b):
    """Width 3 over ``surroundings``, then ReLU."""
    y = w.T @ near
    y += b[:, None]
    np.maximum(y, 0, out=y)

    def back(dy, first):
        dz = dy * (y > 0)
        dw, db = (near @ dz.transpose(0, 2, 1)).sum(0), dz.sum(0).sum(1)
        if first:
            return None, dw, db
        parts = (w @ dz).reshape(len(dz), 3, len(w) // 3, -1)
        dx = parts[:, 1].copy()
        dx[:-1] += parts[1:, 0]
        dx[1:] += parts[:-1, 2]
        return dx, dw, db

    return y, back


def halved(x):
    """The larger of each two steps, an odd last one dropped; a tie goes to the first."""
    half = len(x) // 2
    one, two = x[0 : 2 * half : 2], x[1 : 2 * half : 2]

    def back(dy):
        dx = np.empty_like(x)
        dx[2 * half :] = 0
        second = np.multiply(dy, two > one, out=dx[1 : 2 * half : 2])
        np.subtract(dy, second, out=dx[0 : 2 * half : 2])
        return dx

    return np.maximum(one, two), back


def recurrent(given, own):
    """Hidden states of all steps of some recurrences side by side: ``given`` is steps by recurrences by gates by rows, in the order input, forget, cell, output, and ``own`` holds a matrix for each."""
    steps, many, _, n = given.shape
    hidden = own.shape[1]
    turned = np.ascontiguousarray(own.transpose(0, 2, 1))
    gates, cells, states = given, np.empty((steps + 1, many, hidden, n)), np.empty((steps + 1, many, hidden, n))
    bent, met = np.empty((steps, many, hidden, n)), np.empty((many, 4 * hidden, n))
    cells[0], states[0] = 0, 0
    split = gates.reshape(steps, many, 4, hidden, n)
    with np.errstate(over="ignore"):
        for k in range(steps):
            z = gates[k]
            if k:
                z += np.matmul(turned, states[k], out=met)
            i, f, g, o = (split[k, :, j] for j in range(4))
            cell = np.tanh(g)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
            g[...] = cell
            np.multiply(f, cells[k], out=cells[k + 1])
            cells[k + 1] += np.multiply(i, cell, out=cell)
            np.tanh(cells[k + 1], out=bent[k])
            np.multiply(o, bent[k], out=states[k + 1])

    def back(dout):
        """Gradients of ``given`` and of ``own``."""
        dh, dc, dgiven = np.zeros((many, hidden, n)), np.zeros((many, hidden, n)), np.empty_like(gates)
        for k in reversed(range(steps)):
            dh += dout[k]
            i, f, g, o = (split[k, :, j] for j in range(4))
            dz = dgiven[k].reshape(many, 4, hidden, n)
            of_cell = 1 - bent[k] * bent[k]
            of_cell *= o
            of_cell *= dh
            dc += of_cell
            np.multiply(dc, g, out=dz[:, 0])
            np.multiply(dc, cells[k], out=dz[:, 1])
            np.multiply(dc, i, out=dz[:, 2])
            np.multiply(dh, bent[k], out=dz[:, 3])
            dc *= f
            slope = 1 - split[k]
            slope *= split[k]
            np.subtract(1, g * g, out=slope[:, 2])
            dz *= slope
            np.matmul(own, dgiven[k], out=dh)
        return dgiven, (states[:-1] @ dgiven.transpose(0, 1, 3, 2)).sum(0)

    return states[1:], back


def recurrence(inputs, weights):
    """Both directions over the inputs of some nets; ``weights`` has those of each for ahead and back. Gives outputs, ahead and back, of each."""
    steps, _, n = inputs[0].shape
    hidden = len(weights[0][1])
    given = np.empty((steps, 2 * len(inputs), 4 * hidden, n))
    for k, (x, w) in enumerate(zip(inputs, weights)):
        np.matmul(w[0].T, x, out=given[:, 2 * k])
        np.matmul(w[3].T, x[::-1], out=given[:, 2 * k + 1])
    given += np.stack([b for w in weights for b in (w[2], w[5])])[:, :, None]
    states, back_all = recurrent(given, np.stack([m for w in weights for m in (w[1], w[4])]))
    out = np.empty((len(inputs), steps, 2 * hidden, n))
    out[:, :, :hidden] = states[:, ::2].transpose(1, 0, 2, 3)
    out[:, :, hidden:] = states[::-1, 1::2].transpose(1, 0, 2, 3)

    def back(dys):
        dout = np.empty_like(states)
        for k, dy in enumerate(dys):
            dout[:, 2 * k], dout[:, 2 * k + 1] = dy[:, :hidden], dy[::-1, hidden:]
        dz, down = back_all(dout)
        db = dz.sum(0).sum(2)
        found = []
        for k, (x, w) in enumerate(zip(inputs, weights)):
            ahead, behind = dz[:, 2 * k], dz[::-1, 2 * k + 1]
            dx = w[0] @ ahead
            dx += w[3] @ behind
            found.append((dx, *(g for z, j in ((ahead, 2 * k), (behind, 2 * k + 1)) for g in ((x @ z.transpose(0, 2, 1)).sum(0), down[j], db[j]))))
        return found

    return out, back


def together(nets: list[Net], vectors: list[np.ndarray], xs: list[np.ndarray], drops: list[Callable] | None = None):
    """Logits of each net for its rows of values, nets by rows by classes, and a function from their gradients to those of each net's parameters; the nets are ``alike`` and have equally many rows.

    ``drops`` gives of each net the factors of dropout for a name and a number of channels, rows by channels.
    """
    params, found, now, conv_backs = [net.parts(v) for net, v in zip(nets, vectors)], [], [], []
    wholes = {id(x): surroundings(np.ascontiguousarray(x.T)[:, None]) for x in xs}

    def factors(name, some, channels):
        return [drops[t](name, channels).T if drops is not None and nets[t].dropout else None for t in some]

    for p, x in zip(params, xs):
        y, backs = None, []
        for k in range(3):
            y, back_conv = convolve(surroundings(y) if k else wholes[id(x)], p[f"conv{k}"], p[f"conv{k}_bias"])
            y, back_half = halved(y) if k < 2 else (y, None)
            backs.append((back_conv, back_half))
        now.append(y)
        conv_backs.append(backs)
    hidden, layers = nets[0].hidden, []
    for k in range(max(net.layers for net in nets)):
        some = [t for t, net in enumerate(nets) if net.layers > k]
        kept = factors(f"recur{k}", some, 2 * hidden) if k else [None] * len(some)
        names = [f"{way}{k}_{n}" for way in ("ahead", "back") for n in ("in", "own", "bias")]
        out, back_layer = recurrence([now[t] if f is None else now[t] * f for t, f in zip(some, kept)], [[params[t][n] for n in names] for t in some])
        for t, y in zip(some, out):
            now[t] = y
        layers.append((some, kept, names, back_layer))
    last = np.stack(now)
    p = {n: np.stack([each[n] for each in params]) for n in ("attend", "dense", "dense_bias", "out", "out_bias") if n in params[0]}
    y, back_steps = attended(last, p["attend"]) if "attend" in p else (last[:, -1], None)
    mid, back_dense = linear(y, p["dense"], p["dense_bias"])
    kept_dense = [np.ones((nets[0].dense, 1)) if f is None else f for f in factors("dense", range(len(nets)), nets[0].dense)]
    factor = np.stack([np.broadcast_to(f, (nets[0].dense, len(xs[0]))) for f in kept_dense])
    logits, back_out = linear(np.maximum(mid, 0) * factor, p["out"], p["out_bias"])

    def back(d):
        out = [np.zeros(net.size()) for net in nets]
        parts = [net.parts(v) for net, v in zip(nets, out)]

        def put(names, grads, some=range(len(nets))):
            for name, g in zip(names, grads):
                for t in some:
                    parts[t][name][...] = g[t]

        dy, *each = back_out(d.transpose(0, 2, 1))
        put(("out", "out_bias"), each)
        dy, *each = back_dense(dy * factor * (mid > 0))
        put(("dense", "dense_bias"), each)
        if back_steps:
            dy, *each = back_steps(dy)
            put(("attend",), each)
            dnow = list(dy)
        else:
            dnow = list(np.zeros_like(last))
            for g, of_last in zip(dnow, dy):
                g[-1] = of_last
        for some, kept, names, back_layer in reversed(layers):
            for t, f, (dx, *each) in zip(some, kept, back_layer([dnow[t] for t in some])):
                dnow[t] = dx if f is None else dx * f
                for name, g in zip(names, each):
                    parts[t][name][...] = g
        for t, backs in enumerate(conv_backs):
            dy = dnow[t]
            for k in (2, 1, 0):
                back_conv, back_half = backs[k]
                dy, parts[t][f"conv{k}"][...], parts[t][f"conv{k}_bias"][...] = back_conv(back_half(dy) if back_half else dy, not k)
        return out

    return logits.transpose(0, 2, 1), back


def scores(net: Net, vector: np.ndarray, x: np.ndarray, drops=None):
    """``together`` for one net: logits, rows by classes, and a function from their gradients to that of the parameters."""
    logits, back = together([net], [vector], [x], None if drops is None else [drops])
    return logits[0], lambda d: back(d[None])[0]


def linear(x, w, b):
    return w.transpose(0, 2, 1) @ x + b[:, :, None], lambda dy: (w @ dy, x @ dy.transpose(0, 2, 1), dy.sum(2))


def attended(x, w):
    """Steps summed by the softmax of their products with ``w``, net by net."""
    u = w[:, None, None] @ x
    a = np.exp(u - u.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)

    def back(dy):
        da = (x * dy[:, None]).sum(2, keepdims=True)
        du = a * (da - (a * da).sum(1, keepdims=True))
        return a * dy[:, None] + du * w[:, None, :, None], (x @ du.transpose(0, 1, 3, 2)).sum(1)[:, :, 0]

    return (x * a).sum(1), back


def losses(logits: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each row, and the gradients of their sum. Labels may be by net."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    chance = e / e.sum(axis=-1, keepdims=True)
    at = np.broadcast_to(labels, chance.shape[:-1])[..., None]
    own = np.take_along_axis(chance, at, -1)
    np.put_along_axis(chance, at, own - 1, -1)
    return -np.log(own[..., 0]), chance
