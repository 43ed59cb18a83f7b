import numpy as np
from beadframe.functions import stats


def test_mixture_uses_every_value_in_any_order():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.beta(2, 12, 15_000), rng.beta(12, 2, 15_000)])
    cut = stats.beta_mixture(x, [0.5])
    assert cut == stats.beta_mixture(rng.permutation(x), [0.5])
    # Twice the same values are the same mixture, and the cut is the lower state's largest of all.
    assert np.allclose(cut, stats.beta_mixture(np.repeat(x, 2), [0.5]), atol=1e-12)
