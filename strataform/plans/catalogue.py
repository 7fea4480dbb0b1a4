"""Every query of the library by name, and the SQL that it equals."""

from __future__ import annotations

from strataform.plans import engineering, graphs, relations, series, spaces, vectors, workflows

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (relations, series, vectors, spaces, graphs, engineering, workflows):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
