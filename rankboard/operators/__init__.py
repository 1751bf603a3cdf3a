"""DataFrame operators: roster, grading, leaderboard, snapshot, ranking and join helpers.

Every function takes and returns DataFrames and builds a lazy plan; the only
eager steps are bounded ones (a row-count check before a broadcast, and the
parquet lineage cut of the distributed rank).
"""
