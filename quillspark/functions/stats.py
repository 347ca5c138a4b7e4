"""Exact tests and rating mathematics on plain numbers (used inside vectorised functions and on small results)."""

from __future__ import annotations

import math

import numpy as np

SCALE, START = 173.7178, 1500.0


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test; ties are left out before."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def vote_verdict(wins: int, losses: int, least: int = 10, level: float = 0.05) -> str:
    if wins + losses < least:
        return "too few"
    if sign_test(wins, losses) > level:
        return "level"
    return "leads" if wins > losses else "behind"


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact test of the table [[a, b], [c, d]]: all tables no likelier than the one seen."""
    r, s, k = a + b, c + d, a + c
    n = r + s
    if n == 0:
        return 1.0
    lg = math.lgamma
    base = lg(r + 1) + lg(s + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1)
    log_p = lambda x: base - lg(x + 1) - lg(r - x + 1) - lg(k - x + 1) - lg(s - k + x + 1)
    seen = log_p(a)
    total = sum(math.exp(log_p(x)) for x in range(max(0, k - s), min(r, k) + 1) if log_p(x) <= seen + 1e-7)
    return min(1.0, total)


def glicko(mu: float, phi: float, sigma: float, games: list[tuple[float, float, float, float]], tau: float = 0.5) -> tuple[float, float, float]:
    """One rating period; games: (opponent's rating, deviation, score 0..1, weight). Without games the deviation grows."""
    m, v_inv, gain = (mu - START) / SCALE, 0.0, 0.0
    for r, rd, score, weight in games:
        q = rd / SCALE
        g = 1 / math.sqrt(1 + 3 * q * q / math.pi**2)
        e = 1 / (1 + math.exp(-g * (m - (r - START) / SCALE)))
        v_inv += weight * g * g * e * (1 - e)
        gain += weight * g * (score - e)
    return glicko_after(mu, phi, sigma, v_inv if games else None, gain, tau)


def glicko_after(mu: float, phi: float, sigma: float, v_inv: float | None, gain: float, tau: float = 0.5) -> tuple[float, float, float]:
    """The period's end from two sums over its games: what they tell (v_inv; None: no games) and by how much they surprise (gain)."""
    m, p = (mu - START) / SCALE, phi / SCALE
    if v_inv is None:
        return mu, SCALE * math.sqrt(p * p + sigma * sigma), sigma
    v = 1 / v_inv if v_inv else 1e12
    delta = v * gain
    a = math.log(sigma * sigma)
    f = lambda x: math.exp(x) * (delta * delta - p * p - v - math.exp(x)) / (2 * (p * p + v + math.exp(x)) ** 2) - (x - a) / (tau * tau)
    lo = a
    if delta * delta > p * p + v:
        hi = math.log(delta * delta - p * p - v)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        hi = a - k * tau
    f_lo, f_hi = f(lo), f(hi)
    while abs(hi - lo) > 1e-6:  # Illinois: regula falsi that halves the value kept at a stale end
        mid = lo + (lo - hi) * f_lo / (f_hi - f_lo)
        f_mid = f(mid)
        if f_mid * f_hi <= 0:
            lo, f_lo = hi, f_hi
        else:
            f_lo /= 2
        hi, f_hi = mid, f_mid
    s = math.exp(lo / 2)
    star = math.sqrt(p * p + s * s)
    new = 1 / math.sqrt(1 / star**2 + v_inv)
    return START + SCALE * (m + new * new * gain), SCALE * new, s


def bradley_terry(pairs: list[tuple[int, int, float]], prior: float = 1.0, rounds: int = 2000, tol: float = 1e-10) -> dict[int, float]:
    """Strengths by minorisation-maximisation from (winner, loser, weight), with `prior` half-won games against a unit opponent;
    strengths have a geometric mean of one after every round.
    """
    ids = sorted({x for p in pairs for x in p[:2]})
    at = {x: i for i, x in enumerate(ids)}
    n = np.zeros((len(ids), len(ids)))
    wins = np.full(len(ids), prior / 2)
    for w, loser, weight in pairs:
        wins[at[w]] += weight
        n[at[w], at[loser]] += weight
        n[at[loser], at[w]] += weight
    s = np.ones(len(ids))
    for _ in range(rounds):
        new = wins / ((n / (s[:, None] + s[None, :])).sum(1) + prior / (s + 1))
        new /= np.exp(np.log(new).mean())
        if np.abs(new - s).max() < tol:
            s = new
            break
        s = new
    return dict(zip(ids, s.tolist()))


def bootstrap(diffs: np.ndarray, rounds: int = 2000, seed: int = 1) -> tuple[float, float, float]:
    """Mean of paired differences and its 95 % percentile interval, seeded."""
    if not len(diffs):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.sort([diffs[rng.integers(0, len(diffs), len(diffs))].mean() for _ in range(rounds)])
    return float(diffs.mean()), float(means[int(0.025 * rounds)]), float(means[int(0.975 * rounds) - 1])


def team_draft(a: list[int], b: list[int], n: int, seed: int) -> list[tuple[int, str]]:
    """Interleaving: in each round both arms add their best item not yet taken, a seeded coin says which goes first."""
    rng, out, taken = np.random.default_rng(seed), [], set()
    while len(out) < n:
        order = [("a", a), ("b", b)] if rng.random() < 0.5 else [("b", b), ("a", a)]
        added = False
        for arm, items in order:
            pick = next((x for x in items if x not in taken), None)
            if pick is not None and len(out) < n:
                taken.add(pick)
                out.append((pick, arm))
                added = True
        if not added:
            break
    return out
