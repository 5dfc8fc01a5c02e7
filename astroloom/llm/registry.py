"""The corpus operators' queries and their SQL, in one place for the driver's entry module."""

from . import ann, clustering, decontaminate, langid, licenses, mixing, packing, pitman_yor, secrets, simhash, toxicity, urls, whitening

_MODULES = (ann, secrets, packing, decontaminate, simhash, urls, licenses, langid, toxicity, pitman_yor, clustering, whitening, mixing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
