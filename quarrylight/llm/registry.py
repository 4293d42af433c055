"""Queries of the training-data operators and, where SQL can express them, their SQL twins."""

from quarrylight.llm import ann, audit, decontaminate, html_text, langid, licenses, neardup, packing, pieces, spelling, substrings, topk, toxicity

_MODULES = (licenses, topk, html_text, toxicity, langid, neardup, substrings, pieces, ann, packing, spelling, audit, decontaminate)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}

import corpus_pipeline  # noqa: E402

QUERIES["pipeline"] = corpus_pipeline.run
SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
