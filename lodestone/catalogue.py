"""All queries of the library by name, with the DuckDB text that each must agree with."""

from lodestone.operators import claims, events, search
from lodestone.plans import ledgers, lives, packet, payloads, rules
from lodestone.streaming import log

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (search, events, claims, packet, ledgers, rules, lives, payloads, log):
    QUERIES |= _module.C.queries
    ORACLE_SQL |= _module.C.oracle
