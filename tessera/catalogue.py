"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import evaluation, posts, programs, texts, training

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (posts, evaluation, texts, programs, training):
    if clash := QUERIES.keys() & _module.catalogue.queries.keys():
        raise ValueError(f"registered twice: {clash}")
    QUERIES |= _module.catalogue.queries
    ORACLE |= _module.catalogue.sql
