"""Sums by tiles of pairs against the kernels' matrices, close and coincident points included."""

import numpy as np
import pytest

from orbweave.functions import kernels


def scene(n, m, seed=0):
    """Two heaps and a cloud; some targets on sources or a hair away, sources that coincide."""
    rng = np.random.default_rng(seed)
    s, t = rng.normal(0.5, 0.2, (n, 3)), rng.normal(0.5, 0.2, (m, 3))
    s[: n // 4], t[: m // 4] = 0.25 + 0.001 * s[: n // 4], 0.25 + 0.001 * t[: m // 4]
    s[-n // 8 :] = s[-1]
    t[-5:], t[-9:-5] = s[-5:], s[:4] + 1e-9
    return s, t, rng


@pytest.mark.parametrize("kernel", [kernels.Laplace(), kernels.Helmholtz(2.5), kernels.Helmholtz(900.0), kernels.Yukawa(0.5)], ids=repr)
@pytest.mark.parametrize("gradient", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (3, 700), (2500, 1400)])
def test_sums_are_those_of_the_matrix(kernel, gradient, size):
    s, t, rng = scene(max(size[0], 20), max(size[1], 20))
    s, t = s[-size[0] :], t[-size[1] :]
    q = rng.random((len(s), 2)) + (1j * rng.random((len(s), 2)) if kernel.complex else 0)
    found = kernels.evaluate(kernel, t, s, q, gradient)
    m = kernel.matrix(t, s, gradient)
    expected, scale = m @ q, np.abs(m) @ np.abs(q)  # the sums of the terms' sizes
    assert found.shape == expected.shape and found.dtype == expected.dtype
    assert (np.abs(found - expected) <= 1e-11 * scale).all()


def test_sums_are_several_times_as_fast_as_the_matrix():
    from time import perf_counter

    s, t, rng = scene(20_000, 2000)
    s, t, q = rng.random(s.shape), rng.random(t.shape), np.ones((len(s), 1))

    def least(run):
        return min(-perf_counter() + (run(), perf_counter())[1] for _ in range(3))

    assert least(lambda: kernels.evaluate(kernels.Laplace(), t, s, q)) < 0.5 * least(lambda: [kernels.Laplace().matrix(t[i : i + 100], s) @ q for i in range(0, 2000, 100)])


def test_points_without_sound_coordinates_stay_apart():
    """A NaN or infinite coordinate spoils no other target's sum."""
    s, t, _ = scene(600, 600)
    t[7], t[8] = np.nan, np.inf
    found = kernels.evaluate(kernels.Laplace(), t, s, np.ones((600, 1)))
    rest = np.r_[0:7, 9:600]
    assert np.allclose(found[rest], kernels.evaluate(kernels.Laplace(), t[rest], s, np.ones((600, 1))), rtol=1e-12)


def test_a_matrix_of_its_own_outweighs_inherited_radial_parts():
    class Twice(kernels.Laplace):
        def matrix(self, targets, sources, gradient=False):
            return 2 * super().matrix(targets, sources, gradient)

    s, t, _ = scene(40, 30)
    assert np.allclose(kernels.evaluate(Twice(), t, s, np.ones((40, 1))), 2 * kernels.evaluate(kernels.Laplace(), t, s, np.ones((40, 1))), rtol=1e-12)
