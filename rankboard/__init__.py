"""rankboard: leaderboard analytics as Spark DataFrame jobs.

Two scoring models are supported:

* response-sum: score = SUM(points_earned) over an append-only response log
  (``operators.leaderboard``), fed in batch or by Structured Streaming
  (``streaming``);
* snapshot: a mutable per-participant ``score`` column seeded at 0 and raised by
  increments (``operators.snapshot``).

Every public function takes and returns DataFrames; only ``sources.tables`` and
``streaming`` write anything.
"""

__all__ = ["constants", "schemas", "session"]
