"""The queries of the library and the SQL that says the same."""

from nephos.plans import codecs, defined, extra, files, grids, kernels, levels, misc, more, records, scores, stores, texts, vertical

PARTS = (records, scores, codecs, levels, vertical, grids, defined, extra, more, stores, kernels, files, texts, misc)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
FLAGSHIP = "bias_std"
