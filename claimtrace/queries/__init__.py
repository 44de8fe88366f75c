"""Named queries over the given tables, each with the SQL that checks it."""

from claimtrace.queries import anomaly, cases, recovery, search, streams

FAMILIES = (anomaly, cases, search, recovery, streams)

QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
