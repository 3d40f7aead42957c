"""Collects every registered query and its oracle SQL."""

from __future__ import annotations

from penmark.plans import registry


def _load():
    # importing the modules registers their queries
    from penmark.plans import text_queries  # noqa: F401
    from penmark.plans import ngram_queries  # noqa: F401
    from penmark.plans import pair_queries  # noqa: F401
    from penmark.plans import prep_queries  # noqa: F401
    from penmark.plans import syntax_queries  # noqa: F401
    from penmark.plans import clean_queries  # noqa: F401
    from penmark.plans import io_queries  # noqa: F401
    from penmark.plans import model_queries  # noqa: F401


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    from penmark.plans.oracles import ORACLES
    _load()
    return {k: v for k, v in ORACLES.items() if k in registry.QUERIES}
