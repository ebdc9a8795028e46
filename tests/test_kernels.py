import numpy as np
import pytest
from pyspark.sql import functions as F

from brookwave.operators import kernels as K

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("m", [4, 30, 64, 120, 480])
def test_transforms_equal_their_sums(m):
    x, y = RNG.normal(size=(3, 2 * m)), RNG.normal(size=(3, m))
    c = np.cos(np.pi / m * (np.arange(2 * m)[:, None] + (m + 1) / 2) * (np.arange(m) + 0.5))
    assert np.allclose(K.mdct(x), 2 * x @ c)
    assert np.allclose(K.imdct(y), y @ c.T / m)


@pytest.mark.parametrize("window", [K.sine_window(32), K.kbd_window(32, 4.0), K.kbd_window(32, 6.0)])
def test_windowed_blocks_give_the_signal_back(window):
    m, x = 32, RNG.normal(size=32 * 9)
    assert np.allclose(window**2 + window[::-1] ** 2, 1)
    shape = np.concatenate([window, window[::-1]])
    blocks = np.array([K.imdct(K.mdct(x[k : k + 2 * m] * shape)[None])[0] for k in range(0, len(x) - m, m)])
    # the doubled forward sum over the inverse's division by m: two blocks together give the samples back
    assert np.allclose(K.overlap_added(blocks, window)[m:], x[m:-m])


def test_prediction():
    x = RNG.normal(size=(5, 200))
    for i in range(2, 200):
        x[:, i] += 1.2 * x[:, i - 1] - 0.6 * x[:, i - 2]
    r = K.autocorrelation(x, 4)
    k, gain = K.levinson(r)
    a = K.step_up(k)
    for row in range(5):
        full = np.array([[r[row, abs(i - j)] for j in range(4)] for i in range(4)])
        assert np.allclose(a[row, 1:], np.linalg.solve(full, -r[row, 1:]))
    assert (np.abs(k) < 1).all() and (gain > 1).all()
    assert np.allclose(K.all_pole(K.all_zero(x, a), a), x)
    assert np.allclose(K.levinson(np.zeros((2, 4)))[0], 0)


def test_quantised_reflections_are_close_and_stable():
    k = np.linspace(-0.999, 0.999, 101)
    for bits in (3, 4):
        index, value = K.quantised_reflections(k, bits)
        assert np.abs(index).max() <= 1 << (bits - 1) and (np.abs(value) < 1).all()
        assert np.abs(np.arcsin(value) - np.arcsin(k)).max() < np.pi / (1 << bits)
        assert (K.quantised_reflections(value, bits)[0] == index).all()


def test_noise_and_pulses():
    a, state = K.noise(0x1F2E3D4C, 16, 2.0)
    b, _ = K.noise(state, 16, 2.0)
    assert np.isclose((a * a).sum(), 2.0) and not np.allclose(a, b) and np.allclose(np.concatenate([a, b]).shape, 32)
    assert K.with_pulses(np.array([0, 3, -2, 0]), 0, [0, 1, 1], [1, 2, 3]).tolist() == [-1, 5, -5, 0]
    with pytest.raises(ValueError):
        K.with_pulses(np.zeros(3, int), 2, [1], [1])


def test_columns(spark):
    rows = [(0, [1.0, 2.0, 3.0, 4.0]), (1, None), (2, []), (3, [1.0, None]), (4, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "id int, x array<double>")
    got = {r.id: (r.y, r.l) for r in d.select("id", K.fast_imdct(F.col("x")).alias("y"), K.lags(2)(F.col("x")).alias("l")).collect()}
    assert len(got[0][0]) == 8 and len(got[4][0]) == 4 and got[1] == got[2] == got[3] == (None, None)
    assert got[0][1] == [30.0, 20.0, 11.0] and got[4][1] == [1.0, 0.0]
