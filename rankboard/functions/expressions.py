"""Scalar column expressions of the leaderboard.

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` only, so a
projection using them compiles into the surrounding whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Python's str.strip() removes every character for which str.isspace() holds
# (tabs, newlines, NBSP, ideographic space, ...); SQL trim() removes only ' '.
# The set is derived from that rule, then trimmed with btrim (no regex per row).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_answer(x) -> Column:
    """``s.strip().lower()`` for grading."""
    return F.lower(F.btrim(_c(x), F.lit(PY_WHITESPACE)))


def grade_points(answer, correct, points: int = K.POINTS_PER_QUESTION,
                 correct_is_normalized: bool = False) -> Column:
    """Points for one answer: ``points`` when the normalised texts agree, else 0.

    Pass ``correct_is_normalized`` when ``correct`` was normalised once upstream
    (the answer key), so only the answer is normalised per row.  A NULL answer or
    NULL correct answer earns 0 (``valid_submissions`` removes those first).
    """
    c = _c(correct) if correct_is_normalized else normalize_answer(correct)
    return (F.when(normalize_answer(answer) == c, F.lit(points))
            .otherwise(F.lit(0)).cast("int"))


def feedback_text(answer, correct) -> Column:
    """Feedback shown after a submission: exact (un-normalised) comparison."""
    return (F.when(_c(answer) == _c(correct), F.lit(K.FEEDBACK_CORRECT))
            .otherwise(F.concat(F.lit(K.FEEDBACK_INCORRECT_PREFIX), _c(correct))))


def first_email(emails) -> Column:
    """``emails[0].value``; NULL for a missing or empty array."""
    return F.try_element_at(_c(emails), F.lit(1)).getField("value")


def _by_rank(rank, mapping: dict[int, str], default) -> Column:
    """``mapping[rank]`` for the listed positions, ``default`` (a Column) otherwise."""
    r = _c(rank)
    expr = default
    for pos in sorted(mapping, reverse=True):
        expr = F.when(r == pos, F.lit(mapping[pos])).otherwise(expr)
    return expr


def medal(rank) -> Column:
    return _by_rank(rank, K.MEDALS, F.concat(F.lit("#"), _c(rank).cast("string")))


def tier(rank) -> Column:
    return _by_rank(rank, K.TIERS, F.lit("none"))


def row_class(rank) -> Column:
    return _by_rank(rank, K.ROW_CLASSES, F.lit(""))


def progress_pct(points, max_score) -> Column:
    """``points / max * 100`` as double, 0.0 when max is 0; not capped."""
    m = _c(max_score) if not isinstance(max_score, int) else F.lit(max_score)
    return (F.when(m > 0, _c(points).cast("double") / m.cast("double") * F.lit(100.0))
            .otherwise(F.lit(0.0)))


def progress_label(progress) -> Column:
    """``f"{p:.0f}%"``: Python rounds half to even, Spark's %.0f rounds half up."""
    return F.format_string("%.0f%%", F.bround(_c(progress), 0))


def is_complete(progress) -> Column:
    return _c(progress) == F.lit(100.0)


def answered_label(answered, n_questions) -> Column:
    n = F.lit(n_questions) if isinstance(n_questions, int) else _c(n_questions)
    return F.concat_ws("/", _c(answered).cast("string"), n.cast("string"))


def first_token(name) -> Column:
    return F.element_at(F.split(_c(name), " "), 1)


def last_token(name) -> Column:
    return F.element_at(F.split(_c(name), " "), -1)


def truncate_id(x) -> Column:
    c = _c(x)
    return (F.when(F.length(c) > K.ID_TRUNCATE_OVER,
                   F.concat(F.substring(c, 1, K.ID_TRUNCATE_KEEP), F.lit(K.ID_TRUNCATE_SUFFIX)))
            .otherwise(c))


def clock_label(ts) -> Column:
    return F.date_format(_c(ts), K.CLOCK_FORMAT)
