"""The registry of core queries and their SQL counterparts."""

from quarrylight.plans import analytics, answers, code, counterparts, graphs, links, pipeline

_MODULES = (pipeline, graphs, analytics, code, answers, links)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in (*_MODULES, counterparts) for k, v in m.ORACLES.items()}
