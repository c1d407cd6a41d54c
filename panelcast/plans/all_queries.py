"""Import every catalog module so that all queries are registered."""

from panelcast.plans import catalog  # noqa: F401
from panelcast.plans import q_relational, q_profile, q_windows, q_quality, q_stats, q_model, q_train  # noqa: F401

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
