"""Discrete Bayesian-network analytics as Spark DataFrame operators."""

from bnlake.spec import NetworkSpec, Node, default_spec, docs_spec

__all__ = ["NetworkSpec", "Node", "default_spec", "docs_spec"]
