"""All queries of the subpackage."""

from chatloom.llm import q1, q3, q4, q5, q67, q8

_MODULES = (q1, q3, q4, q5, q67, q8)
QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
