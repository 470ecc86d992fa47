"""Fit a network on any DataFrame and query it -- the user-level entry point.

    model = FittedNetwork.fit(train_df, spec)            # CPTs, factors
    post = model.posterior(test_df, track="ex_ante")     # (key, class, class_ord, p)

The case table is raw (mapped column names); nodes, domains and CPTs are
derived and checkpointed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bnlake.operators import cpt as cptops
from bnlake.operators import posterior, prep, sampling
from bnlake.session import keep
from bnlake.spec import DEFAULT_ALPHA, DEFAULT_M, NetworkSpec


class FittedNetwork:
    def __init__(self, spec: NetworkSpec, cpt: DataFrame, domain_df: DataFrame,
                 alpha: float, m: float, backoff: bool):
        self.spec, self.cpt, self.domain_df = spec, cpt, domain_df
        self.alpha, self.m, self.backoff = alpha, m, backoff
        self.spark = cpt.sparkSession
        self.doms = cptops.collect_domains(domain_df)
        self.card = keep(cptops.domain_card(domain_df))
        self.factors_long = cptops.factor_long(self.spark, cpt, self.card, spec, self.doms, alpha)
        self.factors = posterior.network_factors(self.factors_long, spec, self.doms)
        self._ordered = None

    @classmethod
    def fit(cls, df: DataFrame, spec: NetworkSpec, alpha: float = DEFAULT_ALPHA,
            m: float = DEFAULT_M, backoff: bool = True) -> "FittedNetwork":
        spec = spec.restrict(df.columns)
        nodes = keep(prep.rename_nodes(df, spec))
        dom = keep(prep.value_domains(nodes, spec))
        counts = keep(cptops.cpt_counts(nodes, spec))
        cpt = cptops.fit_network(nodes, spec, alpha, m, backoff, counts=counts, domains=dom)
        return cls(spec, cpt, dom, alpha, m, backoff)

    def evidence(self, df: DataFrame, track=None) -> DataFrame:
        return prep.evidence_project(df, self.spec, track,
                                     with_target=self.spec.column(self.spec.target) in df.columns)

    def posterior(self, df: DataFrame, track=None, query: str | None = None) -> DataFrame:
        ev = self.evidence(df, track)
        ev_vars = [v for v in self.spec.track(track) if v in ev.columns]
        return posterior.posterior_exact(self.spark, self.spec, self.factors, self.doms, ev,
                                         ev_vars, query=query)

    @property
    def ordered(self):
        if self._ordered is None:
            self._ordered = sampling.draw_tables(self.factors_long, self.spec)
        return self._ordered

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        return sampling.ancestral_sample(self.spark, self.spec, self.ordered, self.doms, n, seed)

    def posterior_rejection(self, df: DataFrame, track=None, n: int = 5000, seed: int = 42) -> DataFrame:
        ev = self.evidence(df, track)
        ev_vars = [v for v in self.spec.track(track) if v in ev.columns]
        return sampling.posterior_rejection(self.spark, self.spec, self.sample(n, seed), self.doms,
                                            ev, ev_vars)

    def posterior_lw(self, df: DataFrame, track=None, n: int = 1000, seed: int = 42) -> DataFrame:
        ev = self.evidence(df, track)
        ev_vars = [v for v in self.spec.track(track) if v in ev.columns]
        return sampling.posterior_likelihood_weighting(self.spark, self.spec, self.ordered, self.doms,
                                                       ev, ev_vars, n, seed)
