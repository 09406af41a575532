"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from pricewire.plans import q_eval, q_models, q_prices, q_splits, q_terms, q_text, q_topics  # noqa: F401
from pricewire.plans import q_files, q_io, q_more  # noqa: F401,E402  (these reuse the oracle strings above)
from pricewire.plans.base import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
