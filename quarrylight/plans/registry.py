"""All queries of the library outside the training-data operators."""

from quarrylight.plans import answers, catalog, citing, evidence, followup, records

_MODULES = (evidence, records, catalog, followup, citing, answers)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
