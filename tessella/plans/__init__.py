"""Named queries over the driver tables; importing this package registers them all."""

from tessella.plans import aggs, composites, dialogue, inference, joins, lift, parsers, records, samples, scans, scrubs, streams, studies, texts  # noqa: F401
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
