import random

from shelfspark.functions import udfs as U


def best(found, most):
    """Every stretch that begins with a highlight."""
    top = 0.0
    for a, _, _ in found:
        inside = [f for f in found if f[0] >= a and f[1] <= a + most]
        top = max(top, sum(f[2] for f in inside))
    return top


def test_clusters_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        found, at = [], 0
        for _ in range(rnd.randint(0, 12)):
            at += rnd.randint(1, 30)
            n = rnd.randint(1, 12)
            found.append((at, at + n, rnd.choice([1.0, 1.5, 2.0])))
            at += n
        got = U.cluster(found, 40)
        assert (got[2] if got else 0.0) == __import__("pytest").approx(best(found, 40))
        assert got is None or got[1] - got[0] <= 40


def test_window_counts_places_and_letters():
    assert U.window([(0, 5), (50, 5), (58, 5)], 20) == (50, 63, 3.0)
    assert U.window([], 20) is None and U.window([(0, 30)], 20) is None
