"""Every registered query of the memory engine, with its SQL."""

from . import cascade, state, text, upkeep

QUERIES: dict = {**state.QUERIES, **text.QUERIES, **upkeep.QUERIES, **cascade.QUERIES}
ORACLE_SQL: dict = {**state.ORACLE_SQL, **text.ORACLE_SQL, **upkeep.ORACLE_SQL, **cascade.ORACLE_SQL}
