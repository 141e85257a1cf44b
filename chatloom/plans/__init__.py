"""The queries of the library's operators, with their SQL where SQL can express them."""

from chatloom.plans import corpus, reference

_MODULES = (reference, corpus)
QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
