"""A bidirectional LSTM in numpy: batched forward and backward passes and Adam, shared by the two recurrent labellers."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def init(rng: np.random.Generator, inputs: int, hidden: int, outputs: int) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        p[f"wx_{side}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
        p[f"wh_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"b_{side}"] = np.r_[np.ones(hidden), np.zeros(3 * hidden)]  # forget gates start open
    p["wo"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, outputs))
    p["bo"] = np.zeros(outputs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(gates_in: np.ndarray, mask: np.ndarray, wh: np.ndarray, keep: bool):
    """Hidden states of one direction; ``gates_in`` is (batch, time, 4 hidden). Masked steps keep the state."""
    batch, time, four = gates_in.shape
    n = four // 4
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out, tape = np.empty((batch, time, n), np.float32), []
    for t in range(time):
        z = gates_in[:, t] + h @ wh
        s = _sigmoid(z[:, : 3 * n])
        f, i, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
        m = mask[:, t, None]
        c2 = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(c2)
        h2 = m * (o * tc) + (1 - m) * h
        if keep:
            tape.append((h, c, f, i, o, g, tc, m))
        h, c = h2, c2
        out[:, t] = h
    return out, tape


def _back(dout: np.ndarray, tape, wh: np.ndarray):
    batch, time, n = dout.shape
    dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    dz_all, dwh = np.empty((batch, time, 4 * n), np.float32), np.zeros_like(wh)
    for t in range(time - 1, -1, -1):
        h, c, f, i, o, g, tc, m = tape[t]
        dh = dh + dout[:, t]
        do, dcell = dh * m * tc, dc + dh * m * o * (1 - tc * tc)
        dz = np.concatenate([dcell * m * c * f * (1 - f), dcell * m * g * i * (1 - i), do * o * (1 - o), dcell * m * i * (1 - g * g)], 1)
        dz_all[:, t] = dz
        dwh += h.T @ dz
        dh = dz @ wh.T + dh * (1 - m)
        dc = dcell * (m * f + (1 - m))
    return dz_all, dwh


def scores(p: dict, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Output scores (batch, time, outputs) from the input parts of the gates of both directions (biases included)."""
    hf, _ = _run(gates_f, mask, p["wh_f"], False)
    hb, _ = _run(gates_b[:, ::-1], mask[:, ::-1], p["wh_b"], False)
    return np.concatenate([hf, hb[:, ::-1]], 2) @ p["wo"] + p["bo"]


def forward(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return scores(p, x @ p["wx_f"] + p["b_f"], x @ p["wx_b"] + p["b_b"], mask)


class Adam:
    def __init__(self, p: dict, rate: float = 5e-3):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, loss) -> tuple[float, dict]:
    """``loss``: scores -> (value, gradient of the scores, gradients of parameters of its own)."""
    hf, tf = _run(x @ p["wx_f"] + p["b_f"], mask, p["wh_f"], True)
    hb, tb = _run((x @ p["wx_b"] + p["b_b"])[:, ::-1], mask[:, ::-1], p["wh_b"], True)
    both = np.concatenate([hf, hb[:, ::-1]], 2)
    value, dy, grads = loss(both @ p["wo"] + p["bo"])
    flat = both.reshape(-1, both.shape[2])
    grads = grads | {"wo": flat.T @ dy.reshape(-1, dy.shape[2]), "bo": dy.sum((0, 1))}
    dboth = dy @ p["wo"].T
    n = hf.shape[2]
    for side, d, tape, xs in (("f", dboth[:, :, :n], tf, x), ("b", dboth[:, ::-1, n:], tb, x[:, ::-1])):
        dz, grads[f"wh_{side}"] = _back(d, tape, p[f"wh_{side}"])
        grads[f"wx_{side}"] = xs.reshape(-1, xs.shape[2]).T @ dz.reshape(-1, dz.shape[2])
        grads[f"b_{side}"] = dz.sum((0, 1))
    return value, grads


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(batch, longest, ...) and its mask."""
    longest = max(map(len, seqs))
    x = np.zeros((len(seqs), longest, *seqs[0].shape[1:]), np.float32)
    mask = np.zeros((len(seqs), longest), np.float32)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    return x, mask


def batches(lengths: list[int], cells: int = 40_000):
    """Indices in batches of like lengths that hold at most ``cells`` padded places (a longer one is alone)."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) + 1) * lengths[i] > cells:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch
