"""The recurrent steps against the formula, in results and in time."""

import random
import time

import numpy as np

from tickloom.llm.toxicity import UNITS, WINDOW, Network, Text


class Plain(Network):
    """Each step as the formula has it, one array an operation."""

    def _read(self, gates, at, mask, d):
        gates = np.concatenate((2 * gates[: 2 * UNITS], gates[2 * UNITS :])) if hasattr(Network, "_gates") else gates
        steps, lanes = len(at), at[0].stop - at[0].start if isinstance(at[0], slice) else at.shape[1]
        u, h = np.ascontiguousarray(self.w[f"rec_{d}"].T), np.zeros((UNITS, lanes), np.float32)
        out = np.empty((steps, UNITS, lanes), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            x, r = gates[:, at[t]], u @ h
            zr = 0.5 * np.tanh(0.5 * (x[: 2 * UNITS] + r[: 2 * UNITS])) + 0.5
            new = np.tanh(x[2 * UNITS :] + zr[UNITS:] * r[2 * UNITS :])
            h = new + zr[:UNITS] * (h - new)
            h = h if mask is None else h * mask[t]
            out[t] = h
        return out


def networks():
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(n)) for n in [1, 2, WINDOW - 1, WINDOW, WINDOW + 1, 30, 0, 5, 40_000]]
    text = Text(texts)
    made = [kind(text.hashes, np.zeros(len(text.hashes), np.float32)) for kind in (Network, Plain)]
    for net in made:
        for d in "fb":
            net.w[f"rec_{d}"] *= 4
            net.w[f"bias_{d}"] += np.linspace(-1, 1, 3 * UNITS, dtype=np.float32)
    return made, text, len(texts)


def test_same_scores_as_the_formula():
    (net, plain), text, n = networks()
    got, want = net.highest(text, n), plain.highest(text, n)
    assert np.isneginf(got[6]) and np.isneginf(want[6])
    assert np.allclose(got, want, atol=1e-5) and np.ptp(want[:6]) > 0.01
    assert np.allclose(net.highest(text, n, lanes=7)[:8], want[:8], atol=1e-5)


def test_steps_take_less_than_the_formula():
    """The least of several times of either, by turns."""
    (net, plain), text, n = networks()
    least = {net: np.inf, plain: np.inf}
    for _ in range(9):
        for each in least:
            began = time.process_time()
            each.highest(text, n)
            least[each] = min(least[each], time.process_time() - began)
    assert least[net] < 0.92 * least[plain]
