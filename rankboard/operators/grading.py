"""Submission guard, grading against the question bank, feedback, options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import feedback_text, grade_points, normalize_answer
from ..sources.literal import literal_frame


def question_bank(spark: SparkSession, rows=None) -> DataFrame:
    """The question bank as a DataFrame (``id`` is the question's 1-based position)."""
    return literal_frame(spark, rows if rows is not None else K.QUESTION_BANK, S.QUESTION_BANK)


def valid_submissions(responses: DataFrame) -> DataFrame:
    """Keep submissions the application would store: an answer that is neither
    NULL nor empty, from a known (non-NULL) user."""
    return responses.where(
        F.col("user_answer").isNotNull() & (F.col("user_answer") != F.lit(""))
        & F.col("user_id").isNotNull())


def answer_key(bank: DataFrame) -> DataFrame:
    """``question_id -> correct_answer`` plus its normalised form, computed once per question.

    A question id that occurs twice raises when the key is used: it would grade answers twice.
    """
    one = (bank.groupBy(F.col("id").cast("int").alias("question_id"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("correct_answer").alias("correct_answer")))
    twice = F.raise_error(F.concat(F.lit("question id occurs more than once in the bank: "), F.col("question_id")))
    one = one.select("question_id", F.when(F.col("_n") > 1, twice.cast("string"))
                     .otherwise(F.col("correct_answer")).alias("correct_answer"))
    return one.withColumn("_correct_norm", normalize_answer("correct_answer"))


def assign_response_ids(responses: DataFrame, col: str = "response_id") -> DataFrame:
    """Give rows without an id a random UUID (the reference's ``uuid4``).

    ``uuid()`` is non-deterministic: a recomputed task draws new ids.  Streams
    and replayable loads should carry ids from their source instead.
    """
    if col not in responses.columns:
        return responses.withColumn(col, F.expr("uuid()"))
    return responses.withColumn(col, F.coalesce(F.col(col), F.expr("uuid()")))


def grade_supplied(responses: DataFrame, points: int = K.POINTS_PER_QUESTION) -> DataFrame:
    """Grade responses that already carry their ``correct_answer`` (the reference's
    ``submit_response(user_id, question_id, user_answer, correct_answer)``)."""
    return responses.withColumn("points_earned", grade_points("user_answer", "correct_answer", points))


def grade(responses: DataFrame, bank: DataFrame | None, points: int = K.POINTS_PER_QUESTION,
          key: DataFrame | None = None) -> DataFrame:
    """Attach ``correct_answer`` and ``points_earned`` to each response.

    No hint is given: the planner broadcasts the answer key while its estimated or
    measured size is under the session's threshold, and beyond it AQE splits the few
    hot question ids of a shuffled join.  ``key`` may be passed ready-made.  Responses
    to questions that the bank lacks have no grade; ``ungraded`` returns them.
    """
    if key is None:
        key = answer_key(bank)
    base = responses.drop("correct_answer", "points_earned")
    return (base.join(key, "question_id", "inner")
                .withColumn("points_earned",
                            grade_points("user_answer", "_correct_norm", points, correct_is_normalized=True))
                .drop("_correct_norm"))


def grade_or_flag(responses: DataFrame, bank: DataFrame, points: int = K.POINTS_PER_QUESTION) -> DataFrame:
    """Every response, graded like ``grade``, with ``known``: whether its question is in the bank (if not, it has
    no grade).  One join for both outcomes."""
    key = answer_key(bank).withColumn("known", F.lit(True))
    base = responses.drop("correct_answer", "points_earned")
    earned = grade_points("user_answer", "_correct_norm", points, correct_is_normalized=True)
    return (base.join(key, "question_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
                .withColumn("points_earned", F.when(F.col("known"), earned)).drop("_correct_norm"))


def ungraded(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """The responses that ``grade`` has no answer for: their question is not in the bank (or NULL)."""
    return responses.join(bank.select(F.col("id").cast("int").alias("question_id")), "question_id", "left_anti")


def answer_feedback(graded: DataFrame) -> DataFrame:
    """Feedback text (exact comparison) next to the normalised grade.

    ``disagrees`` marks answers graded correct but told "Incorrect" (padding or
    case differences) or vice versa.
    """
    exact = F.coalesce(F.col("user_answer") == F.col("correct_answer"), F.lit(False))
    return (graded.withColumn("feedback", feedback_text("user_answer", "correct_answer"))
                  .withColumn("exact_match", exact)
                  .withColumn("disagrees", (F.col("points_earned") > 0) != exact))


def question_options(bank: DataFrame) -> DataFrame:
    """One row per (question, option) with its 1-based position and correctness."""
    return (bank.select(F.col("id").alias("question_id"), "correct_answer",
                        F.posexplode("options").alias("pos0", "option"))
                .select("question_id", (F.col("pos0") + 1).alias("pos"), "option",
                        (F.col("option") == F.col("correct_answer")).alias("is_correct")))


def max_score(bank: DataFrame, points: int = K.POINTS_PER_QUESTION) -> DataFrame:
    """One row: number of questions and the maximum attainable score."""
    return bank.agg(F.count(F.lit(1)).alias("n_questions"),
                    (F.count(F.lit(1)) * F.lit(points)).alias("max_score"))
