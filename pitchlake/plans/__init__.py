"""The registered queries: operators on adapters of the given tables, with their SQL."""

from . import backtests, chances, evaluations, feeds, forecasts, growth, identity, league, merges, records, results, staff

_PARTS = (growth, league, results, forecasts, records, feeds, evaluations, identity, backtests, merges, chances, staff)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
