"""Registered queries over the stand-in tables, and the SQL that checks them."""

from __future__ import annotations

from . import boxes, clips, ledgers, measures, media, runs, stored

QUERIES: dict = {}
SQL: dict = {}
for part in (ledgers, boxes, measures, clips, runs, media, stored):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
