"""All registered queries of the library and their SQL, by SURVEY id."""

from __future__ import annotations

from weft.plans import arrays, chat, ensembles, learning, maps, models, online, searching, streams, text, tuning

_MODULES = [arrays, chat, text, learning, models, streams, ensembles, online, maps, searching, tuning]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
