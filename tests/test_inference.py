"""Exact inference against a brute-force joint; samplers against exact."""
import itertools

import pytest
from pyspark.sql import functions as F

from bnlake.operators import posterior
from bnlake.plans.model import FittedNetwork


@pytest.fixture(scope="module")
def model(small_df, small_spec):
    return FittedNetwork.fit(small_df, small_spec)


def brute_force(model, evidence: dict, query: str):
    spec, doms = model.spec, model.doms
    tables = {}
    for n in spec.names:
        f = model.factors[n]
        tables[n] = {tuple(r[v] for v in f.variables): r["w"] for r in f.df.collect()}
    out = {v: 0.0 for v in doms[query]}
    for combo in itertools.product(*[doms[n] for n in spec.names]):
        a = dict(zip(spec.names, combo))
        if any(a[k] != v for k, v in evidence.items() if v in doms[k]):
            continue
        w = 1.0
        for n in spec.names:
            w *= tables[n][tuple(a[v] for v in spec.parents(n) + [n])]
        out[a[query]] += w
    tot = sum(out.values())
    return {k: v / tot for k, v in out.items()}


def test_cpt_rows_sum_to_one(model):
    pas = [f"pa{i}" for i in range(1, model.spec.max_parents + 1)]
    sums = model.cpt.groupBy("node", "depth", *pas).agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    assert model.cpt.filter("p <= 0").count() == 0


def test_backoff_formula_depth_one(model):
    # P1(c | a) = lam * ML + (1 - lam) * P0(c), lam = n_pa / (n_pa + 5)
    rows = {(r.depth, r.pa1, r.value): r for r in model.cpt.filter("node = 'c'").collect()}
    for (d, pa1, v), r in rows.items():
        if d != 1:
            continue
        lam = r.n_pa / (r.n_pa + 5.0)
        assert r.p == pytest.approx(lam * r.n / r.n_pa + (1 - lam) * rows[(0, None, v)].p)


def test_exact_matches_brute_force(spark, model):
    cases = spark.createDataFrame(
        [(1, "0", "1", None, None), (2, None, None, "2", "0"), (3, "2", "0", "1", "1"),
         (4, "9", None, None, None)],           # out-of-domain value: ignored
        "id long, a string, b string, c string, d string")
    post = model.posterior(cases, track="all").collect()
    got = {}
    for r in post:
        got.setdefault(r.id, {})[r["class"]] = r.p
    ev = {1: {"a": "0", "b": "1"}, 2: {"c": "2", "d": "0"}, 3: {"a": "2", "b": "0", "c": "1", "d": "1"},
          4: {"a": "9"}}
    for i, e in ev.items():
        want = brute_force(model, e, "y")
        for k, v in want.items():
            assert got[i][k] == pytest.approx(v, abs=1e-12)


def test_root_posterior_equals_marginal(spark, model):
    one = spark.createDataFrame([(1,)], "id long")
    post = posterior.posterior_exact(spark, model.spec, model.factors, model.doms, one, [], query="a")
    marg = {r.value: r.p for r in model.cpt.filter("node = 'a' AND depth = 0").collect()}
    for r in post.collect():
        assert r.p == pytest.approx(marg[r["class"]], abs=1e-9)


def test_full_evidence_leaf_is_cpt_row(spark, model):
    cases = spark.createDataFrame([(1, "1", "0")], "id long, c string, d string")
    fe = posterior.posterior_full_evidence(spark, model.spec, model.factors["y"], model.doms, cases)
    row = {r.y: r.w for r in model.factors["y"].df.filter("c = '1' AND d = '0'").collect()}
    for r in fe.collect():
        assert r.p == pytest.approx(row[r["class"]], abs=1e-12)


def test_tv_distance_bounds(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 0.5), (2, "y", 0.5)], "case_id long, class string, p double")
    b = spark.createDataFrame([(1, "y", 1.0), (2, "x", 0.5), (2, "y", 0.5)], "case_id long, class string, p double")
    tv = {r.case_id: r.tv for r in posterior.tv_distance(a, b).collect()}
    assert tv == {1: 1.0, 2: 0.0}


def _tv(exact, approx):
    j = posterior.tv_distance(exact, approx, "id")
    return j.agg(F.max("tv")).first()[0]


def test_samplers_converge_to_exact(spark, model):
    cases = spark.createDataFrame([(1, "0", "1"), (2, "2", "0")], "id long, a string, b string")
    exact = model.posterior(cases, track="roots")
    assert _tv(exact, model.posterior_lw(cases, track="roots", n=20000)) < 0.05
    assert _tv(exact, model.posterior_rejection(cases, track="roots", n=20000)) < 0.05


def test_sampling_is_deterministic(model):
    a = sorted(model.sample(300, seed=5).collect())
    b = sorted(model.sample(300, seed=5).collect())
    assert a == b


def test_gibbs_converges_to_exact(spark, model):
    from bnlake.operators import sampling
    cases = spark.createDataFrame([(1, "0", "1", None, None), (2, None, None, "2", "0")],
                                  "id long, a string, b string, c string, d string")
    exact = model.posterior(cases, track="all")
    ev = model.evidence(cases, "all")
    g = sampling.posterior_gibbs(spark, model.spec, model.factors_long, model.doms, ev,
                                 ["a", "b", "c", "d"], n=20000, burn_in=500, seed=3)
    assert _tv(exact, g) < 0.05


def enumerate_joint(model):
    """Every full assignment of the small network with its probability."""
    import itertools
    spec, doms = model.spec, model.doms
    cells = {}
    for r in model.factors_long.collect():
        pas = tuple(r[f"pa{i + 1}"] for i in range(len(spec.parents(r["node"]))))
        cells[r["node"], pas, r["value"]] = r["p"]
    for combo in itertools.product(*[doms[n] for n in spec.names]):
        at = dict(zip(spec.names, combo))
        p = 1.0
        for n in spec.names:
            p *= cells[n, tuple(at[x] for x in spec.parents(n)), at[n]]
        yield at, p


@pytest.mark.parametrize("query", ["y", "b"])
def test_every_null_pattern_against_enumeration(spark, model, query):
    """One clique tree answers all patterns, unknown values included."""
    import itertools
    names = [v for v in model.spec.names if v != query]
    vals = {"a": ["0", "1", None], "b": ["0", None], "c": ["1", None], "d": ["0", None, "no such value"], "y": ["2", None]}
    combos = list(itertools.product(*[vals[v] for v in names]))
    rows = [(i, *combo) for i, combo in enumerate(combos)]
    ev = spark.createDataFrame(rows, "id long, " + ", ".join(f"{v} string" for v in names))
    got = {(r.id, r["class"]): r.p for r in posterior.posterior_exact(
        spark, model.spec, model.factors, model.doms, ev, names, query=query).collect()}
    joint = list(enumerate_joint(model))
    for i, *combo in rows:
        seen = {v: x for v, x in zip(names, combo) if x in model.doms[v]}
        mass = {c: sum(p for at, p in joint if at[query] == c and all(at[v] == x for v, x in seen.items())) for c in model.doms[query]}
        total = sum(mass.values())
        for c in model.doms[query]:
            assert abs(got.pop((i, c)) - (mass[c] / total if total else 1 / len(mass))) < 1e-12
    assert not got


def test_number_of_plans_does_not_grow_with_patterns(spark, model, monkeypatch):
    import itertools
    made = []
    monkeypatch.setattr(posterior.CliqueTree, "_clique", lambda self, i, v, f=posterior.CliqueTree._clique: made.append(v) or f(self, i, v))
    combos = list(itertools.product(["0", None], repeat=4))
    for few in (combos[:2], combos):
        ev = spark.createDataFrame([(i, *c) for i, c in enumerate(few)], "id long, a string, b string, c string, d string")
        assert posterior.posterior_exact(spark, model.spec, model.factors, model.doms, ev, ["a", "b", "c", "d"]).count() == 3 * len(few)
    assert len(made) <= 2 * len(model.spec.names)


def test_evidence_ids_differ(spark):
    from bnlake.operators.sampling import evidence_id
    df = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), ("-", "z"), (None, "z"), ("1:x", "z")], "a string, b string")
    assert df.select(evidence_id(["a", "b"]).alias("i")).distinct().count() == 5


def test_codes_as_doubles_and_ints_are_one_value(spark, small_spec):
    from bnlake.operators import prep
    df = spark.createDataFrame([(1, 1.0, 2.0, "3.0", 4, 5.5)], "id long, a double, b double, c string, d int, y double")
    r = prep.rename_nodes(df, small_spec).first()
    assert (r.a, r.b, r.c, r.d, r.y) == ("1", "2", "3", "4", "5.5")


def test_rejection_without_accepted_samples_is_uniform(spark, model):
    """No sample matches the evidence -> uniform over the query's domain."""
    cases = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(
        [("0", "0"), ("0", "1"), ("1", "0"), ("1", "1"), ("2", "0"), ("2", "1")])],
        "id long, a string, b string")
    post = model.posterior_rejection(cases, track="roots", n=1).collect()
    by_case = {}
    for r in post:
        by_case.setdefault(r.id, []).append(r.p)
    uniform = [ps for ps in by_case.values() if all(abs(p - 1 / 3) < 1e-12 for p in ps)]
    assert len(by_case) == 6 and len(uniform) == 5      # one sample matches one configuration


def test_unseen_root_value_probability(spark, model):
    """T4: a root value never seen in training gets alpha / (alpha V + alpha)."""
    from bnlake.operators import cpt
    M = model.spec.max_parents
    q = spark.createDataFrame([("a", "never-seen")], "node string, value string")
    for i in range(1, M + 1):
        q = q.withColumn(f"pa{i}", F.lit(None).cast("string"))
    r = cpt.cpt_lookup(q, model.cpt, model.card, M, alpha=1.0).first()
    V = len(model.doms["a"])
    assert r.p == pytest.approx(1.0 / (V + 1)) and r.hit_depth == 0


def test_levels_cover_observed_configs_with_all_values(small_df, small_spec, model):
    """Level-k rows exist for observed parent prefixes only, each with every
    child value (zero counts included)."""
    from bnlake.operators import prep
    nodes = prep.rename_nodes(small_df, small_spec)
    observed = {(r.a, r.b) for r in nodes.select("a", "b").distinct().collect()}
    rows = model.cpt.filter("node = 'd' AND depth = 2").collect()
    V = len(model.doms["d"])
    assert {(r.pa1, r.pa2) for r in rows} == observed
    assert len(rows) == len(observed) * V


def test_rows_of_a_clique_are_dealt_before_they_fan_out(spark, model, monkeypatch):
    """Evidence rows with gaps are few bytes but much work: no task gets all of them."""
    made = []
    clique = posterior.CliqueTree._clique
    monkeypatch.setattr(posterior.CliqueTree, "_clique", lambda self, *a: made.append((self.tasks, clique(self, *a))) or made[-1][1])
    monkeypatch.setattr(posterior, "CONFIGS_PER_TASK", 1)
    rows = [(i, *[v if (i >> n) & 1 else None for n, v in enumerate(("0", "1", "1", "0"))]) for i in range(16)]
    ev = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    out = posterior.posterior_exact(spark, model.spec, model.factors, model.doms, ev, ["a", "b", "c", "d"])
    assert out.count() == 16 * model.doms.card("y")
    coded = [(n, m) for n, m in made if m.codes]
    assert coded and all(n == 16 and "REPARTITION_BY_NUM, [" in m.factor.df._jdf.queryExecution().executedPlan().toString()
                         for n, m in coded)


def test_stand_ins_count_every_case(spark, model):
    """Mean TV over stand-ins is the mean over the cases, also where keys come twice (with the
    same or other evidence, meeting each other in the join) or are null; the stand-ins of
    cases with keys of their own are no more than the distinct evidence rows."""
    from bnlake.operators import sampling
    rows = [(i, str(i % 3), None if i % 5 == 0 else str(i % 2)) for i in range(200)]
    rows += [(300, "0", "1"), (300, "0", "1"), (301, "0", "1"), (301, "2", None), (None, "1", "0"), (None, "1", "0"), (None, "2", "1"),
             (302, "9", "9"), (303, None, None)]
    cases = spark.createDataFrame(rows, "id long, a string, b string")
    few = posterior.stand_ins(cases, ["a", "b"], model.doms, "id").localCheckpoint()
    alone = few.filter("id.cid IS NOT NULL")
    assert few.count() == 10 + 4 + 3 and alone.count() == 10
    assert few.select(F.sum(posterior.stands_for("id"))).first()[0] == 202 + 4 + 3

    def curve(ev, weight):
        exact = posterior.posterior_exact(spark, model.spec, model.factors, model.doms, ev, ["a", "b"])
        post = sampling.posterior_likelihood_weighting(spark, model.spec, model.ordered, model.doms, ev, ["a", "b"], counts=(3, 40))
        return {r.n_samples: r.tv for r in sampling.sampler_convergence(exact, post, "id", weight).collect()}

    want, got = curve(cases, None), curve(few, posterior.stands_for("id"))
    assert want.keys() == got.keys() == {3, 40}
    assert all(got[n] == pytest.approx(want[n], abs=1e-12) for n in want)


def test_convergence_joins_no_row_a_case(spark, monkeypatch):
    """The rows that the curves join are as many as the distinct evidence rows need, not the cases."""
    from types import SimpleNamespace

    from bnlake.operators import cpt, prep
    from bnlake.plans import registry
    spec, track = registry.SPEC, registry.EXANTE
    cols = [f"CAST(id % {i % 3 + 2} AS STRING) AS {v}" for i, v in enumerate(spec.names)]
    nodes = spark.range(60).selectExpr(*cols).localCheckpoint()
    net = FittedNetwork(spec, cpt.fit_network(nodes, spec), prep.value_domains(nodes, spec).localCheckpoint(), 1.0, 5.0, True)
    ev = spark.range(3000).selectExpr(f"id AS {registry.KEY}", *cols).select(registry.KEY, *track).localCheckpoint()
    exact = posterior.posterior_exact(spark, spec, net.factors, net.doms, ev, track)
    fake = SimpleNamespace(_post={}, doms=net.doms, factors=net.factors, factors_long=net.factors_long,
                           evidence=lambda track: ev, posterior=lambda track: exact)
    monkeypatch.setattr(registry, "pipeline", lambda *a: fake)
    monkeypatch.setattr(registry, "LW_COUNTS", (5, 20))
    joined, tv_distance = [], posterior.tv_distance
    monkeypatch.setattr(posterior, "tv_distance", lambda a, b, key: joined.append((a.count(), b.count())) or tv_distance(a, b, key))
    rows = {r.n_samples: r.tv for r in registry.q_convergence(spark, "").collect()}
    n = ev.select(*track).distinct().count()
    assert len(joined) == 2 and all(max(x) <= n * net.doms.card(spec.target) for x in joined)
    for c, post in registry._lw(spark, "").items():
        assert rows[c] == pytest.approx(tv_distance(exact, post, registry.KEY).agg(F.avg("tv")).first()[0], abs=1e-12)
