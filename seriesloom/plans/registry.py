"""Every registered query and its SQL twin."""

from . import insight_queries, panel_queries, risk_queries, story_queries

QUERIES: dict = {}
ORACLE: dict = {}
for module in (panel_queries, risk_queries, story_queries, insight_queries):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
