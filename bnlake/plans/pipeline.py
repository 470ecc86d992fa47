"""The train/evaluate plan (the reference's main mode) as reusable artifacts.

``Pipeline(spark, sf_dir)`` lazily builds and materialises, once per session
and data directory: prepared cases -> chronological split -> node table ->
domains -> grouping-set counts -> backoff CPT -> factor tables -> posteriors
per track.  Each artifact is checkpointed into ``spark.checkpoint.dir`` so
later plans start from a short lineage and survive executor loss.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.operators import cpt as cptops
from bnlake.operators import metrics, posterior, prep, split
from bnlake.session import ensure_checkpoint_dir, keep
from bnlake.sources.cases import raw_cases, raw_docs
from bnlake.spec import DEFAULT_ALPHA, DEFAULT_M, NetworkSpec, default_spec, docs_spec

_CACHE: dict = {}


def pipeline(spark: SparkSession, sf_dir: str, view: str = "cases", **kw) -> "Pipeline":
    k = (spark.sparkContext.applicationId, sf_dir, view, tuple(sorted(kw.items())))
    if k not in _CACHE:
        _CACHE[k] = Pipeline(spark, sf_dir, view, **kw)
    return _CACHE[k]


def truth_of(df: DataFrame, spec: NetworkSpec) -> DataFrame:
    return df.select(spec.key, prep.canonical_column(df, spec.column(spec.target)).alias("y_true"))


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str, view: str = "cases",
                 alpha: float = DEFAULT_ALPHA, m: float = DEFAULT_M, backoff: bool = True):
        ensure_checkpoint_dir(spark)
        self.spark, self.sf_dir, self.view = spark, sf_dir, view
        self.alpha, self.m, self.backoff = alpha, m, backoff
        self.spec: NetworkSpec = docs_spec() if view == "docs" else default_spec()
        self._post: dict = {}

    # -- data ---------------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        if self.view == "docs":
            return raw_docs(self.spark, self.sf_dir)
        return raw_cases(self.spark, self.sf_dir)

    @cached_property
    def cases(self) -> DataFrame:
        return keep(prep.prepare_cases(self.raw, self.spec))

    @property
    def prepared(self) -> DataFrame:
        """The prepared cases for a query that reads them once: the stored ones if there are
        any, else their plan, so that they aren't written and read only for it."""
        return self.cases if "cases" in self.__dict__ else prep.prepare_cases(self.raw, self.spec)

    @cached_property
    def split(self) -> DataFrame:
        """The stored cases with a flag: the cut is a literal, so the rows aren't stored again."""
        return split.split_chrono(self.cases, self.spec.order_col, self.spec.key)

    @property
    def train(self) -> DataFrame:
        return self.split.filter(F.col("is_train"))

    @property
    def test(self) -> DataFrame:
        return self.split.filter(~F.col("is_train"))

    @cached_property
    def nodes(self) -> DataFrame:
        return keep(prep.rename_nodes(self.train, self.spec))

    # -- model ----------------------------------------------------------------
    @cached_property
    def configs(self) -> DataFrame:
        """Distinct rows of the node table with their number: all that the fit reads, in one
        pass over the training cases."""
        nodes = prep.rename_nodes(self.train, self.spec)
        return keep(cptops.weighted(nodes, self.spec.restrict(nodes.columns, by_name=True).names))

    @cached_property
    def domain_df(self) -> DataFrame:
        return keep(prep.value_domains(self.configs, self.spec))

    @cached_property
    def doms(self) -> cptops.Domains:
        return cptops.collect_domains(self.domain_df)

    @cached_property
    def card(self) -> DataFrame:
        return keep(cptops.domain_card(self.domain_df))

    @cached_property
    def counts(self) -> DataFrame:
        return keep(cptops.cpt_counts(self.configs, self.spec, weight="_w"))

    @cached_property
    def cpt(self) -> DataFrame:
        return cptops.fit_network(self.configs, self.spec, self.alpha, self.m, self.backoff,
                                  counts=self.counts, domains=self.domain_df)

    @cached_property
    def factors_long(self) -> DataFrame:
        return cptops.factor_long(self.spark, self.cpt, self.card, self.spec, self.doms, self.alpha)

    @cached_property
    def factors(self) -> dict:
        return posterior.network_factors(self.factors_long, self.spec, self.doms)

    # -- inference --------------------------------------------------------------
    def evidence(self, track: str, df: DataFrame | None = None) -> DataFrame:
        return prep.evidence_project(self.test if df is None else df, self.spec, track)

    def posterior(self, track: str) -> DataFrame:
        """(key, class, class_ord, p) for the test cases under a track."""
        if track not in self._post:
            ev = self.evidence(track)
            post = posterior.posterior_exact(self.spark, self.spec, self.factors, self.doms,
                                             ev, self.spec.track(track))
            self._post[track] = keep(post)
        return self._post[track]

    def truth(self) -> DataFrame:
        return truth_of(self.test, self.spec)

    def matrix(self, track: str) -> DataFrame:
        k = ("P", track)
        if k not in self._post:
            P = metrics.predict_distributions(self.posterior(track), self.truth(), self.spec.key)
            self._post[k] = keep(P)
        return self._post[k]

    def scores(self, track: str) -> DataFrame:
        k = ("S", track)
        if k not in self._post:
            self._post[k] = keep(metrics.case_scores(self.matrix(track), self.spec.key))
        return self._post[k]
