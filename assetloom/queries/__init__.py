"""One registered query per operator of the inventory, over the driver's tables, each with equivalent SQL where possible."""

from assetloom.queries import catalog, scalar, signals, sources

QUERIES = {}
SQL = {}
for _m in (scalar, sources, catalog, signals):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
