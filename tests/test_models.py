"""The chain and regression kernels against brute force, and state tables against their rules."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourfold.operators import emission, hmm, mlogit, sites, statespace
from fourfold.plans.options import Options


def small_chain(seed, sizes):
    rng = np.random.default_rng(seed)
    emit = [np.log(rng.dirichlet(np.ones(n))) for n in sizes]
    trans = []
    for a, b in itertools.pairwise(sizes):
        ways = np.argwhere(rng.random((3, 3)) < 0.5)
        m = hmm.Moves.of_codes(rng.integers(0, 3, a), rng.integers(0, 3, b), ways.reshape(-1, 2))
        trans.append(m.with_weight(rng.normal(size=b)))
    return np.log(rng.dirichlet(np.ones(sizes[0]))), trans, emit


def every_path(phi, trans, emit):
    dense = [m.chances() for m in trans]
    for path in itertools.product(*[range(len(e)) for e in emit]):
        s = phi[path[0]] + emit[0][path[0]]
        for t, (i, j) in enumerate(itertools.pairwise(path)):
            s += dense[t][i, j] + emit[t + 1][j]
        yield path, s


@pytest.mark.parametrize("seed", range(8))
def test_forward_backward_and_viterbi(seed):
    phi, trans, emit = small_chain(seed, [3, 4, 2, 3])
    for m in trans:
        assert np.exp(m.chances()).sum(axis=1) == pytest.approx(1)
    paths = [p for p in every_path(phi, trans, emit) if p[1] > -np.inf]
    total = math.log(sum(math.exp(s) for _, s in paths))
    found = hmm.forward_backward(phi, trans, emit)
    assert found["llk"] == pytest.approx(total)
    for t, g in enumerate(found["gamma"]):
        want = [sum(math.exp(s - total) for p, s in paths if p[t] == i) for i in range(len(g))]
        assert np.exp(g) == pytest.approx(want, abs=1e-12)
    path, score = hmm.viterbi(phi, trans, emit)
    best = max(s for _, s in paths)
    assert score == pytest.approx(best)
    assert dict(paths)[tuple(path)] == pytest.approx(best)
    # What is learned: the share of each move among those from its source, over all paths.
    new_phi, new = hmm.update(found, trans)
    assert new_phi == pytest.approx(found["gamma"][0])
    for t, m in enumerate(new):
        xi = np.zeros((len(emit[t]), len(emit[t + 1])))
        for p, s in paths:
            xi[p[t], p[t + 1]] += math.exp(s - total)
        met = xi.sum(axis=1) > 0
        assert np.exp(m.chances())[met] == pytest.approx((xi / xi.sum(axis=1, keepdims=True, where=met[:, None], initial=0))[met], abs=1e-9)


def test_likelihood_does_not_fall():
    phi, trans, emit = small_chain(3, [4, 5, 5, 4, 3])
    last = -np.inf
    for _ in range(10):
        found = hmm.forward_backward(phi, trans, emit)
        assert found["llk"] >= last - 1e-12
        last = found["llk"]
        before = trans
        phi, trans = hmm.update(found, trans)
        assert hmm.log_sum(phi) == pytest.approx(0)
        for m in trans:
            assert np.exp(m.chances()).sum(axis=1) == pytest.approx(1)
    assert max(x.change(y) for x, y in zip(trans, before, strict=True)) < 1


def test_moves_agree_on_shared_codes():
    a, b = np.array([0, 1, 2, 1]), np.array([1, 0, 1, 3])
    got = np.exp(hmm.Moves.agreeing(a, b).chances())
    want = (a[:, None] == b[None, :]).astype(float)
    want[2] = 1  # no other agrees: anywhere
    assert got == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_moves_of_many_states_take_little_room():
    import tracemalloc

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 10_000), rng.integers(0, 2, 10_000)
    tracemalloc.start()
    m = hmm.Moves.agreeing(a, b)
    found = hmm.forward_backward(hmm.uniform_start(10_000), [m], [np.zeros(10_000), np.zeros(10_000)])
    hmm.viterbi(*hmm.update(found, [m]), [np.zeros(10_000), np.zeros(10_000)])
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(6))
def test_stretches_put_together_are_the_whole(seed):
    sizes = [3, 4, 5, 3, 4, 4, 5, 2, 3]
    phi, trans, emit = small_chain(seed, sizes)
    whole = hmm.forward_backward(phi, trans, emit)
    at = [0, 3, 4, 7, 9]
    for best in (False, True):
        pieces = [hmm.folded(phi, trans[a - 1] if a else None, trans[a : b - 1], emit[a:b], trans[b - 1] if b < 9 else None, best) for a, b in itertools.pairwise(at)]
        if best:
            classes, score = hmm.best_cuts(pieces)
            path, top = hmm.viterbi(phi, trans, emit)
            assert score == pytest.approx(top) and [int(trans[c - 1].source[path[c - 1]]) for c in at[1:-1]] == classes
        else:
            ahead, behind, llk = hmm.cuts(pieces)
            assert llk == pytest.approx(whole["llk"], abs=1e-9)
            for x, y in zip(ahead, behind, strict=True):
                assert hmm.log_sum(x + y) == pytest.approx(whole["llk"], abs=1e-9)
    assert hmm.cuts([hmm.folded(phi, None, trans, emit, None)])[2] == pytest.approx(whole["llk"])


def test_logit_recovers_coefficients():
    rng = np.random.default_rng(1)
    n = 60_000
    pos, qua, hap = rng.integers(0, 100, n), rng.integers(12, 42, n), rng.integers(0, 4, n)
    beta = np.array(emission.FIXED_BETA)
    p = mlogit.probabilities(mlogit.design(pos, qua, hap), beta)
    choice = (p.cumsum(axis=1) < rng.random(n)[:, None]).sum(axis=1)
    nuc = np.array([0, 1, 3, 2])[choice]
    fit = mlogit.fit(pos, qua, hap, nuc, np.ones(n))
    assert np.abs(fit.gradient).max() < 1e-2
    assert fit.aic == pytest.approx(2 * 27 - 2 * fit.loglik) and list(fit.coefficients())[:3] == [f"{t}:C" for t in emission.TERMS[:3]]
    assert fit.beta[3, 0] == pytest.approx(beta[3, 0], abs=0.5)
    q = mlogit.probabilities(mlogit.design(pos, qua, hap), fit.beta)
    assert np.abs(p - q).max() < 0.06
    half = mlogit.fit(np.tile(pos, 2), np.tile(qua, 2), np.tile(hap, 2), np.tile(nuc, 2), np.full(2 * n, 0.5))
    assert half.beta == pytest.approx(fit.beta, abs=1e-5)


def test_logit_drops_columns_without_information():
    rng = np.random.default_rng(2)
    fit = mlogit.fit(rng.integers(0, 50, 400), rng.integers(10, 40, 400), rng.integers(0, 2, 400), rng.integers(0, 4, 400), np.ones(400))
    assert np.isnan(fit.beta[4]).all() and np.isnan(fit.beta[5]).all()
    assert np.isfinite(fit.beta[3]).all()


def test_fit_in_spark_is_the_fit_at_hand(spark):
    """Likelihood, gradient and Hessian added up over tasks give the same steps."""
    rng = np.random.default_rng(5)
    n = 5_000
    rows = np.stack([rng.integers(0, 60, n), rng.integers(12, 42, n), rng.integers(0, 4, n), rng.integers(0, 4, n)], axis=1)
    frame = spark.createDataFrame([(*map(int, r), 1.0) for r in rows], "read_pos long, qua long, hap_nuc long, nuc long, w double").repartition(3)
    stats = emission.sufficient_statistics(frame, F.col("w"))
    near, far = mlogit.fit_error_model(stats), mlogit.fit_error_model(stats, most_rows=10)
    assert far.beta == pytest.approx(near.beta, abs=1e-6) and far.loglik == pytest.approx(near.loglik)
    assert far.hessian == pytest.approx(near.hessian, rel=1e-6) and near.iterations == far.iterations


def test_hessian_against_differences():
    rng = np.random.default_rng(6)
    args = (rng.integers(0, 60, 300), rng.integers(12, 42, 300), rng.integers(0, 4, 300), rng.integers(0, 4, 300), rng.random(300))
    beta = np.array(emission.FIXED_BETA)
    _, grad, hess = mlogit.sums(*args, beta)
    for place in (0, 4, 13, 26):
        m, i = divmod(place, 9)
        up, down = beta.copy(), beta.copy()
        up[i, m] += 1e-5
        down[i, m] -= 1e-5
        (f, g, _), (e, h, _) = mlogit.sums(*args, up), mlogit.sums(*args, down)
        assert grad[place] == pytest.approx((f - e) / 2e-5, rel=1e-4, abs=1e-4)
        assert hess[place] == pytest.approx((g - h) / 2e-5, rel=1e-4, abs=1e-3)


def test_log_probabilities_sum_to_one(spark):
    rows = spark.range(40).select((F.col("id") % 100).alias("r"), (F.col("id") % 30 + 10).alias("q"), (F.col("id") % 4).alias("h"))
    p = sum((F.exp(emission.log_probability(F.col("r"), F.col("q"), F.col("h"), F.lit(k), emission.FIXED_BETA)) for k in range(4)), F.lit(0.0))
    assert all(abs(r[0] - 1) < 1e-9 for r in rows.select(p).collect())


def site(spark, n, n_del=0, symbol="M", options=None):
    row = spark.createDataFrame([(0, 0, *n, n_del, sum(n) + n_del, symbol)], "region long, ref_pos long, n0 long, n1 long, n2 long, n3 long, n_del long, depth long, symbol string")
    calls = sites.call_sites(row, options, "symbol")
    states = sites.site_states(calls).orderBy("state_idx").collect()
    return calls.first()["site_class"], [tuple(r[f"h{k}"] for k in range(4)) for r in states]


CASES = [
    ((10, 0, 0, 0), 0, "M", "mono", [(0, 0, 0, 0)]),
    ((19, 1, 0, 0), 0, "M", "mono", [(0, 0, 0, 0)]),
    ((5, 1, 0, 0), 0, "M", "mono", [(0, 0, 0, 0)]),
    ((3, 1, 0, 0), 0, "M", "perm_two", [(0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0)]),
    ((0, 3, 0, 7), 0, "M", "perm_two", [(1, 3, 3, 3), (3, 1, 3, 3), (3, 3, 1, 3), (3, 3, 3, 1), (1, 1, 3, 3), (3, 3, 1, 1)]),
    ((5, 5, 0, 0), 0, "M", "two", [(0, 0, 1, 1), (1, 1, 0, 0)]),
    ((5, 5, 2, 0), 0, "M", "two", [(0, 0, 1, 1), (1, 1, 0, 0)]),
    ((4, 4, 4, 0), 0, "M", "two", [(1, 1, 2, 2), (2, 2, 1, 1)]),  # of equals the lowest code goes
    ((6, 0, 0, 0), 4, "J", "gap2", [(-1, -1, 0, 0), (0, 0, -1, -1)]),
    ((6, 0, 0, 0), 4, "M", "mono", [(0, 0, 0, 0)]),
    ((5, 5, 0, 0), 10, "I", "gap4", [(-1, -1, 0, 1), (-1, -1, 1, 0), (0, 1, -1, -1), (1, 0, -1, -1)]),
    ((5, 5, 0, 0), 10, "M", "two", [(0, 0, 1, 1), (1, 1, 0, 0)]),
    ((8, 2, 0, 0), 10, "J", "gap2", [(-1, -1, 0, 0), (0, 0, -1, -1)]),
]


@pytest.mark.parametrize("n, n_del, symbol, label, states", CASES)
def test_site_states(spark, n, n_del, symbol, label, states):
    assert site(spark, n, n_del, symbol) == (label, states)


def test_double_heterozygotes(spark):
    label, states = site(spark, (5, 5, 0, 0), options=Options(dbheter=1))
    assert label == "two_het"
    assert states[2:] == [(0, 1, 1, 0), (0, 1, 0, 1), (1, 0, 0, 1), (1, 0, 1, 0)]


def test_single_option(spark):
    """No site of two nucleotides is monomorphic, and one permutation stands for each sub-genome."""
    o = Options(single=1)
    assert site(spark, (19, 1, 0, 0), options=o) == ("single", [(0, 0, 0, 1), (0, 1, 0, 0)])
    assert site(spark, (1, 19, 0, 0), options=o) == ("single", [(0, 1, 1, 1), (1, 1, 0, 1)])
    assert site(spark, (5, 5, 0, 0), options=o) == ("two", [(0, 0, 1, 1), (1, 1, 0, 0)])
    assert site(spark, (5, 0, 0, 0), options=o)[0] == "mono"


def test_third_nucleotide(spark):
    o = Options(third_nuc=1)
    label, states = site(spark, (5, 3, 0, 3), options=o)
    assert label == "perm_two" and len(states) == 10
    assert states[:4] == [(1, 3, 0, 0), (3, 1, 0, 0), (0, 0, 1, 3), (0, 0, 3, 1)]
    label, states = site(spark, (4, 4, 4, 0), options=o)
    assert len(states) == 14
    assert states[:12:4] == [(1, 2, 0, 0), (1, 0, 2, 2), (2, 0, 1, 1)]
    assert site(spark, (5, 5, 0, 0), options=o)[1] == [(0, 0, 1, 1), (1, 1, 0, 0)]


def test_options():
    assert Options().having(majority=0.8).majority == 0.8
    with pytest.raises(KeyError):
        Options().having(nothing=1)
    with pytest.raises(TypeError):
        Options().having(max_iter="a")
    for name, value in (("drop_unmapped", 5), ("max_iter", True), ("max_iter", 1.5), ("majority", "x")):
        with pytest.raises(TypeError):
            Options().having(**{name: value})
    assert Options().having(majority=1, single=1, no_emi_update=0, db_penal=0.3).db_penal == 0.3


def test_reads_of_one_start_are_scored_in_blocks(spark, monkeypatch):
    import numpy as np

    from fourfold.operators import statespace

    monkeypatch.setattr(statespace, "BLOCK", 40)
    rng = np.random.default_rng(1)
    reads = [(1, 1, i, -1.0, [(5, rng.normal(size=4).tolist())], [0.25] * 4) for i in range(400)]
    reads = spark.createDataFrame(reads, "region long, t long, read_id long, base double, lp array<struct<site:long,lp:array<double>>>, eta array<double>")
    flat = [0, 0, 1, 1, 0, 1, 1, 1]
    rows = [(1, 1, True, [5], [2], flat, [0, 1]), (1, 2, False, [5], [2], flat, [0, 1])]
    rows = spark.createDataFrame(rows, "region long, t long, begins boolean, sites array<long>, n_states array<int>, states array<int>, combos array<int>")
    left, right = statespace._salted(reads, rows)
    assert max(r["count"] for r in left.groupBy("region", "t", "salt").count().collect()) < 80 and right.count() == 10
    lp = np.array([r["lp"][0]["lp"] for r in reads.orderBy("read_id").collect()])
    x = np.stack([np.log(np.exp(lp[:, states]).mean(axis=1)).sum() for states in ([0, 0, 1, 1], [0, 1, 1, 1])])
    got = {r["t"]: r["emit"] for r in statespace.emissions(reads, rows).collect()}
    assert np.allclose(got[1], x - np.logaddexp(*x)) and np.allclose(got[2], np.log([0.5, 0.5]))
    gamma = rows.withColumn("gamma", statespace.F.array(statespace.F.lit(np.log(0.5)), statespace.F.lit(np.log(0.5))))
    whole = statespace.weights(reads, gamma).filter("site = -1").groupBy("read_id").agg(statespace.F.sum("w").alias("w")).collect()
    assert len(whole) == 400 and all(abs(r["w"] - 1) < 1e-9 for r in whole)
