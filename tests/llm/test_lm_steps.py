"""The steps of the recurrent model keep whole arrays, and give what one step after the other gives."""

import numpy as np

from lakeglean.llm import lm


def test_forward_keeps_whole_arrays():
    r = np.random.default_rng(1)
    p = {"u": r.normal(0, 0.3, (lm.HIDDEN, 3 * lm.HIDDEN)).astype(np.float32)}
    gates = r.normal(0, 1, (lm.START + 1, 3 * lm.HIDDEN)).astype(np.float32)
    x = r.integers(0, lm.START, (9, 5))
    x[0], x[4, 2] = lm.START, lm.START
    kept: list = []
    states, last = lm.forward(p, gates, x, r.normal(0, 1, (5, lm.HIDDEN)).astype(np.float32), kept)
    assert [k.shape for k in kept] == [states.shape] * 5  # none is stacked again
    h, k = np.zeros((5, lm.HIDDEN)), lm.HIDDEN
    for t in range(9):
        h[x[t] == lm.START] = 0
        a, hu = gates[x[t]].astype(float), h @ p["u"].astype(float)
        z, g = (1 / (1 + np.exp(-(a[:, s] + hu[:, s]))) for s in (slice(0, k), slice(k, 2 * k)))
        n = np.tanh(a[:, 2 * k :] + g * hu[:, 2 * k :])
        for got, want in zip(kept, (h, z, g, hu[:, 2 * k :], n), strict=True):
            assert np.allclose(got[t], want, atol=1e-5)
        h = z * h + (1 - z) * n
        assert np.allclose(states[t], h, atol=1e-5)
    assert np.allclose(last, h, atol=1e-5)
    plain, end = lm.forward(p, gates, x, np.zeros((5, lm.HIDDEN), np.float32))
    assert np.array_equal(plain, states) and np.array_equal(end, last)
