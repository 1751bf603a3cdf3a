"""Structured Streaming jobs that keep graded responses and the leaderboard fresh."""

from .jobs import (  # noqa: F401
    LeaderboardRefresher,
    rebuild_board,
    refresh_now,
    start_grading,
    start_leaderboard,
    stream_files,
)
