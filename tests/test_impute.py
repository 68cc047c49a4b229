"""Filled patterns against all fillings."""

import itertools

import numpy as np
import pytest

from fourfold.operators.impute import LETTERS, UNSEEN, best_fill
from fourfold.plans import catalogue


@pytest.mark.parametrize("seed", range(8))
def test_best_fill(seed):
    rng = np.random.default_rng(seed)
    pattern = "".join(rng.choice(list("ACTG--"), 5))
    start = {a: float(x) for a, x in enumerate(np.log(rng.dirichlet(np.ones(4)))) if rng.random() < 0.8}
    follow = {(s, a, b): float(np.log(rng.random())) for s in range(3, 7) for a in range(4) for b in range(4) if rng.random() < 0.8}

    def score(path):
        return start.get(path[0], UNSEEN) + sum(follow.get((3 + k, a, b), UNSEEN) for k, (a, b) in enumerate(itertools.pairwise(path)))

    every = itertools.product(*[range(4) if c == "-" else (LETTERS.index(c),) for c in pattern])
    best = max(score(p) for p in every)
    filled = best_fill(pattern, 3, start, follow)
    assert score([LETTERS.index(c) for c in filled]) == pytest.approx(best)
    assert all(c == "-" or c == d for c, d in zip(pattern, filled, strict=True))


def test_imputed_rows_are_complete(spark, sf_dir):
    rows = catalogue.queries()["imputed_linkage_rows"](spark, sf_dir).collect()
    before = catalogue.queries()["distinct_linkage_rows"](spark, sf_dir).collect()
    assert rows and not any("-" in r["pattern"] for r in rows)
    assert sum(r["n"] for r in rows) == sum(r["n"] for r in before)
