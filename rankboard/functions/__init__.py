"""Column expressions (all built-in Spark functions, so they stay in codegen)."""

from .expressions import (  # noqa: F401
    answered_label,
    clock_label,
    feedback_text,
    first_email,
    first_token,
    grade_points,
    is_complete,
    last_token,
    medal,
    PY_WHITESPACE,
    normalize_answer,
    progress_label,
    progress_pct,
    row_class,
    tier,
    truncate_id,
)
