import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import stats


def test_glicko_worked_example():
    mu, phi, sigma = stats.glicko(1500, 200, 0.06, [(1400, 30, 1.0, 1.0), (1550, 100, 0.0, 1.0), (1700, 300, 0.0, 1.0)])
    assert math.isclose(mu, 1464.06, abs_tol=0.05) and math.isclose(phi, 151.52, abs_tol=0.05) and math.isclose(sigma, 0.05999, abs_tol=1e-4)
    assert stats.glicko(1500, 200, 0.06, [])[1] > 200


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30))
def test_sign_test_is_a_probability_and_symmetric(w, l):  # noqa: E741
    p = stats.sign_test(w, l)
    assert 0 <= p <= 1 and math.isclose(p, stats.sign_test(l, w))


def test_sign_and_fisher_known_values():
    assert math.isclose(stats.sign_test(9, 1), 22 / 1024)
    assert math.isclose(stats.fisher(3, 1, 1, 3), 34 / 70, rel_tol=1e-9)
    assert stats.fisher(0, 0, 0, 0) == 1.0
    assert stats.vote_verdict(3, 2) == "too few" and stats.vote_verdict(18, 2) == "leads" and stats.vote_verdict(2, 18) == "behind"


def test_bradley_terry_orders_by_strength():
    s = stats.bradley_terry([(1, 2, 8.0), (2, 1, 2.0), (2, 3, 8.0), (3, 2, 2.0), (1, 3, 9.0)])
    assert s[1] > s[2] > s[3]


def test_bootstrap_and_draft_are_repeatable():
    d = np.array([1.0, 2.0, 0.0, 1.0])
    assert stats.bootstrap(d) == stats.bootstrap(d)
    mixed = stats.team_draft([1, 2, 3, 4], [4, 3, 2, 1], 4, 9)
    assert sorted(i for i, _ in mixed) == [1, 2, 3, 4] and mixed == stats.team_draft([1, 2, 3, 4], [4, 3, 2, 1], 4, 9)
