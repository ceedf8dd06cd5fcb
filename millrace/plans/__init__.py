"""Queries over the test tables, registered with their oracle SQL."""

from millrace.plans import aggregates, crawl, files, filters, joins, ordered, queues, scalars, search, snapshots, streams, trees  # noqa: F401
