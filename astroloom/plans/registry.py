"""All queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from . import answers, corpus, kinematics, knowledge, light_curves, retrieval, selection, sky, streams, training

_MODULES = (light_curves, retrieval, corpus, knowledge, sky, streams, selection, answers, training, kinematics)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
