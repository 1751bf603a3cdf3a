"""DuckDB SQL that recomputes each query from the raw tables, for cross-checking.

The CTEs mirror ``plans.inputs`` expression for expression; the queries follow
the reference's own SQL where it exists (e.g. the leaderboard joins *then*
groups, so it also checks our aggregate-before-join rewrite).
"""

from __future__ import annotations

from .. import constants as K
from .inputs import ABSENT_USER, PROBE_EMAIL, PROBE_USER

DEMO = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + f", '{K.STATUS_DEMO_LABEL}')" for row in K.DEMO_PARTICIPANTS)

DIR = """dir AS (
  SELECT c_custkey,
         CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lower(c_name) || '@example.com' END AS email,
         replace(c_name, '#', ' ') AS display_name,
         lower(c_name) AS user_name,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 10 <> 0 END AS active
  FROM customer)"""

ROSTER = """roster AS (
  SELECT user_id, email, display_name, user_name FROM dir WHERE coalesce(active, false))"""

RESPONSES = """responses AS (
  SELECT CAST(event_id AS VARCHAR) AS response_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CAST(event_id % 5 + 1 AS INTEGER) AS question_id,
         CASE event_id % 3 WHEN 0 THEN event_type
                           WHEN 1 THEN ' ' || upper(event_type) || ' '
                           ELSE event_type || '!' END AS user_answer,
         event_id
  FROM events)"""

BANK = """bank AS (
  SELECT id, correct_answer
  FROM (VALUES (1, 'view'), (2, 'signup'), (3, 'error'), (4, 'click'), (5, 'purchase')) b(id, correct_answer))"""

NATION_BANK = """bank AS (
  SELECT n_nationkey + 1 AS id, r_name AS correct_answer
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

BLANKS = """blanks AS (
  SELECT response_id, user_id, question_id, event_id,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE user_answer END AS user_answer
  FROM responses)"""

GUARD = "r.user_answer IS NOT NULL AND r.user_answer <> '' AND r.user_id IS NOT NULL"

GRADED = f"""graded AS (
  SELECT r.response_id, r.user_id, r.question_id, r.user_answer, b.correct_answer,
         CAST(CASE WHEN lower(trim(r.user_answer)) = lower(trim(b.correct_answer)) THEN 10 ELSE 0 END
              AS INTEGER) AS points_earned
  FROM responses r JOIN bank b ON r.question_id = b.id
  WHERE {GUARD})"""

BOARD = """board AS (
  SELECT u.user_id, u.display_name, u.email,
         CAST(COALESCE(SUM(r.points_earned), 0) AS BIGINT) AS total_points,
         CAST(COUNT(r.response_id) AS BIGINT) AS questions_answered
  FROM roster u LEFT JOIN graded r ON u.user_id = r.user_id
  GROUP BY u.user_id, u.display_name, u.email)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (ORDER BY total_points DESC, questions_answered DESC, user_id ASC) AS rank
  FROM board)"""

PODIUM = """rank, user_id, display_name, email, total_points, questions_answered,
  CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '#' || CAST(rank AS VARCHAR) END AS medal,
  CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE 'none' END AS tier,
  CASE rank WHEN 1 THEN 'table-warning' WHEN 2 THEN 'table-light' WHEN 3 THEN 'table-info' ELSE '' END AS row_class,
  rank <= 3 AS highlight"""

SEED = """seed AS (
  SELECT user_id AS participant_id,
         CAST(row_number() OVER (ORDER BY user_name ASC NULLS LAST, user_id ASC) AS INTEGER) AS rank,
         display_name, email, user_name AS username,
         label = 'Active' AS is_active, CASE WHEN label = 'Active' THEN 'Active' ELSE 'Inactive' END AS status,
         CAST(0 AS INTEGER) AS score
  FROM labelled)"""

LABELLED = """labelled AS (SELECT *, 'Active' AS label FROM roster)"""

VIEW = """view AS (
  SELECT *, string_split(display_name, ' ')[1] AS first_name, string_split(display_name, ' ')[-1] AS last_name
  FROM incremented)"""

DELTAS = """deltas AS (
  SELECT u.email, SUM(10) AS delta
  FROM events e JOIN roster u ON CAST(e.user_id AS VARCHAR) = u.user_id
  WHERE e.event_type = 'purchase' AND u.email IS NOT NULL
  GROUP BY u.email)"""

INCREMENTED = """incremented AS (
  SELECT s.participant_id, s.rank, s.display_name, s.email, s.username, s.is_active, s.status,
         CAST(s.score + COALESCE(d.delta, 0) AS INTEGER) AS score
  FROM seed s LEFT JOIN deltas d ON s.email = d.email)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (DIR, ROSTER, RESPONSES, BANK, GRADED)
BOARD_BASE = BASE + (BOARD,)

UPDATE_BATCH = """batch AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'updated.' || lower(c_name) || '@example.com'
              ELSE lower(c_name) || '@example.com' END AS email,
         replace(c_name, '#', ' ') AS display_name, lower(c_name) AS user_name
  FROM customer
  UNION ALL
  SELECT CAST(c_custkey + 1000000 AS VARCHAR), 'new' || CAST(c_custkey AS VARCHAR) || '@example.com',
         replace(c_name, '#', ' '), lower(c_name) || '-new'
  FROM customer)"""

LOGINS = """logins AS (
  SELECT lower(c_name) || '@example.com' AS email FROM customer
  UNION ALL
  SELECT 'x' || CAST(c_custkey AS VARCHAR) || '@example.com' FROM customer)"""

NAMES = """names AS (
  SELECT p_name AS name FROM part
  UNION ALL SELECT * FROM (VALUES (''), ('Ann'), ('Ann '), (' Ann'), (NULL)) e(name))"""

RESP_EMAIL = """resp_email AS (
  SELECT response_id, 'customer#' || lpad(user_id, 9, '0') || '@example.com' AS user_id,
         question_id, user_answer
  FROM responses)"""

SQL: dict[str, str] = {
    "roster_ingest": with_(DIR) + """
SELECT user_id, email, display_name, user_name FROM dir WHERE coalesce(active, false)""",
    "roster_ingest_lenient": with_(DIR) + """
SELECT user_id, coalesce(email, '') AS email, display_name, user_name FROM dir WHERE coalesce(active, true)""",
    "namespace_roundtrip": with_(DIR, ROSTER) + "SELECT * FROM roster",
    "roster_active_strict": with_(DIR) + """
SELECT user_id, email, display_name, user_name FROM dir WHERE coalesce(active, false)""",
    "roster_active_lenient": with_(DIR) + """
SELECT user_id, email, display_name, user_name FROM dir WHERE coalesce(active, true)""",
    "roster_counts": with_(DIR) + """
SELECT CAST(count(*) AS BIGINT) AS total_users,
       CAST(sum(CASE WHEN coalesce(active, false) THEN 1 ELSE 0 END) AS BIGINT) AS active_users
FROM dir""",
    "roster_upsert": with_(DIR, ROSTER, UPDATE_BATCH) + """
SELECT coalesce(t.user_id, s.user_id) AS user_id,
       CASE WHEN s.user_id IS NOT NULL THEN s.email ELSE t.email END AS email,
       CASE WHEN s.user_id IS NOT NULL THEN s.display_name ELSE t.display_name END AS display_name,
       CASE WHEN s.user_id IS NOT NULL THEN s.user_name ELSE t.user_name END AS user_name
FROM roster t FULL OUTER JOIN batch s ON t.user_id = s.user_id""",
    "default_rows_empty": with_(DIR, ROSTER) + """, empty AS (SELECT * FROM roster WHERE user_id IS NULL)
SELECT * FROM empty
UNION ALL
SELECT * FROM (VALUES ('1', 'user1@example.com', 'User One', 'user1'),
                      ('2', 'user2@example.com', 'User Two', 'user2'),
                      ('3', 'user3@example.com', 'User Three', 'user3'))
       d(user_id, email, display_name, user_name)
WHERE NOT EXISTS (SELECT 1 FROM empty)""",
    "default_rows_nonempty": with_(DIR, ROSTER) + """
SELECT * FROM roster
UNION ALL
SELECT * FROM (VALUES ('1', 'user1@example.com', 'User One', 'user1'),
                      ('2', 'user2@example.com', 'User Two', 'user2'),
                      ('3', 'user3@example.com', 'User Three', 'user3'))
       d(user_id, email, display_name, user_name)
WHERE NOT EXISTS (SELECT 1 FROM roster)""",
    "eligibility_check": with_(DIR, ROSTER) + f"""
SELECT '{PROBE_EMAIL}' AS email, count(*) > 0 AS eligible FROM roster WHERE email = '{PROBE_EMAIL}'""",
    "eligible_logins": with_(DIR, ROSTER, LOGINS) + """
SELECT l.email FROM logins l WHERE EXISTS (SELECT 1 FROM roster u WHERE u.email = l.email)""",
    "rejected_logins": with_(DIR, ROSTER, LOGINS) + """
SELECT l.email FROM logins l WHERE NOT EXISTS (SELECT 1 FROM roster u WHERE u.email = l.email)""",
    "valid_submissions": with_(RESPONSES) + """
SELECT response_id, user_id, question_id, user_answer FROM (
  SELECT response_id, user_id, question_id,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE user_answer END AS user_answer
  FROM responses) x
WHERE user_answer IS NOT NULL AND user_answer <> '' AND user_id IS NOT NULL""",
    "grade_responses": with_(*BASE) + "SELECT * FROM graded",
    "grade_with_blanks": with_(DIR, ROSTER, RESPONSES, BLANKS, BANK, GRADED.replace("FROM responses r", "FROM blanks r"))
    + "SELECT * FROM graded",
    "ungraded_responses": with_(RESPONSES) + f"""
SELECT response_id, user_id, question_id, user_answer FROM responses r WHERE question_id > 3 AND {GUARD}""",
    "response_ids": "SELECT count(*) AS n_rows, count(*) AS n_ids, true AS well_formed FROM events",
    "submit_append": with_(*BASE) + "SELECT * FROM graded",
    "stream_grade": with_(*BASE) + "SELECT * FROM graded",
    "answer_feedback": with_(*BASE) + """
SELECT *,
       CASE WHEN user_answer = correct_answer THEN 'Correct! ✅'
            ELSE 'Incorrect. The correct answer is: ' || correct_answer END AS feedback,
       coalesce(user_answer = correct_answer, false) AS exact_match,
       (points_earned > 0) <> coalesce(user_answer = correct_answer, false) AS disagrees
FROM graded""",
    "question_options": with_(NATION_BANK) + """
SELECT b.id AS question_id, CAST(o.pos AS INTEGER) AS pos, o.option, o.option = b.correct_answer AS is_correct
FROM bank b, (SELECT r_name AS option, row_number() OVER (ORDER BY r_regionkey) AS pos FROM region) o""",
    "max_score": with_(NATION_BANK) + """
SELECT CAST(count(*) AS BIGINT) AS n_questions, CAST(count(*) * 10 AS BIGINT) AS max_score FROM bank""",
    "leaderboard": with_(*BASE) + """
SELECT u.display_name, u.email,
       CAST(COALESCE(SUM(r.points_earned), 0) AS BIGINT) AS total_points,
       CAST(COUNT(r.response_id) AS BIGINT) AS questions_answered
FROM roster u LEFT JOIN graded r ON u.user_id = r.user_id
GROUP BY u.user_id, u.display_name, u.email""",
    "stream_leaderboard": with_(*BOARD_BASE, RANKED) + f"SELECT {PODIUM} FROM ranked",
    "leaderboard_by_email": with_(*BASE, RESP_EMAIL) + """
SELECT u.display_name, u.email,
       CAST(COALESCE(SUM(CAST(CASE WHEN lower(trim(r.user_answer)) = lower(trim(b.correct_answer))
                                   THEN 10 ELSE 0 END AS INTEGER)), 0) AS BIGINT) AS total_points,
       CAST(COUNT(r.response_id) AS BIGINT) AS questions_answered
FROM roster u
LEFT JOIN (resp_email r JOIN bank b ON r.question_id = b.id) ON u.email = r.user_id
GROUP BY u.user_id, u.display_name, u.email""",
    "leaderboard_ranked": with_(*BOARD_BASE, RANKED) + f"SELECT {PODIUM} FROM ranked",
    "leaderboard_top200": with_(*BOARD_BASE, RANKED) + f"SELECT {PODIUM} FROM ranked WHERE rank <= 200",
    "leaderboard_top20": with_(*BOARD_BASE, RANKED) + f"SELECT {PODIUM} FROM ranked WHERE rank <= 20",
    "leaderboard_page": with_(*BOARD_BASE, RANKED) + f"""
SELECT {PODIUM}, 2 AS page FROM ranked WHERE rank BETWEEN 101 AND 200""",
    "leaderboard_page_last": with_(*BOARD_BASE, RANKED) + f"""
SELECT {PODIUM}, CAST((SELECT (count(*) + 99) // 100 FROM board) AS INTEGER) AS page
FROM ranked WHERE (rank - 1) // 100 = (SELECT (count(*) + 99) // 100 - 1 FROM board)""",
    "leaderboard_progress": with_(*BOARD_BASE) + """
SELECT user_id, display_name, email, total_points, questions_answered,
       CAST(total_points AS DOUBLE) / CAST(50 AS DOUBLE) * CAST(100 AS DOUBLE) AS progress,
       printf('%.0f%%', CAST(total_points AS DOUBLE) / CAST(50 AS DOUBLE) * CAST(100 AS DOUBLE)) AS progress_label,
       CAST(total_points AS DOUBLE) / CAST(50 AS DOUBLE) * CAST(100 AS DOUBLE) = CAST(100 AS DOUBLE) AS complete,
       CAST(questions_answered AS VARCHAR) || '/5' AS answered_label
FROM board""",
    "leaderboard_sorted": with_(*BOARD_BASE) + """
SELECT user_id, display_name, email, total_points, questions_answered,
       row_number() OVER (ORDER BY display_name DESC NULLS LAST, user_id ASC) AS position
FROM board""",
    "user_score": with_(*BASE) + f"""
SELECT '{PROBE_USER}' AS user_id, CAST(COALESCE(SUM(points_earned), 0) AS BIGINT) AS total_points
FROM graded WHERE user_id = '{PROBE_USER}'
UNION ALL
SELECT '{ABSENT_USER}', CAST(COALESCE(SUM(points_earned), 0) AS BIGINT)
FROM graded WHERE user_id = '{ABSENT_USER}'""",
    "participant_count": with_(*BOARD_BASE) + "SELECT CAST(count(*) AS BIGINT) AS participants FROM board",
    "participants_seed_demo": with_(f"""labelled AS (
  SELECT * FROM (VALUES {DEMO}) d(user_id, display_name, email, user_name, label))""", SEED.replace(
        "user_name ASC NULLS LAST, user_id ASC", "user_id ASC")) + "SELECT * FROM seed",
    "participants_top200": with_(DIR, ROSTER, LABELLED, SEED) + "SELECT * FROM seed WHERE rank <= 200",
    "participants_seed": with_(DIR, ROSTER, LABELLED, SEED) + "SELECT * FROM seed",
    "snapshot_refresh": with_(DIR, ROSTER, LABELLED, SEED) + "SELECT * FROM seed",
    "score_increment": with_(DIR, ROSTER, LABELLED, SEED, DELTAS, INCREMENTED) + "SELECT * FROM incremented",
    "leaderboard_view": with_(DIR, ROSTER, LABELLED, SEED, DELTAS, INCREMENTED) + """
SELECT row_number() OVER (ORDER BY score DESC, rank ASC, participant_id ASC) AS position,
       string_split(display_name, ' ')[1] AS first_name,
       string_split(display_name, ' ')[-1] AS last_name,
       email, score
FROM incremented""",
    "view_sorted": with_(DIR, ROSTER, LABELLED, SEED, DELTAS, INCREMENTED, VIEW) + """
SELECT row_number() OVER (ORDER BY last_name DESC NULLS LAST, score DESC, rank ASC, participant_id ASC) AS position,
       first_name, last_name, email, score FROM view""",
    "view_page": with_(DIR, ROSTER, LABELLED, SEED, DELTAS, INCREMENTED, VIEW) + """
SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, rank ASC, participant_id ASC) AS position,
                      first_name, last_name, email, score, 2 AS page FROM view) x
WHERE position BETWEEN 101 AND 200""",
    "view_highlight": with_(DIR, ROSTER, LABELLED, SEED, DELTAS, INCREMENTED, VIEW) + """
SELECT *, position <= 3 AS highlight
FROM (SELECT row_number() OVER (ORDER BY score DESC, rank ASC, participant_id ASC) AS position,
             first_name, last_name, email, score FROM view) x""",
    "name_split": with_(NAMES) + """
SELECT name, string_split(name, ' ')[1] AS first_name, string_split(name, ' ')[-1] AS last_name
FROM names""",
    "id_truncate": """
SELECT name, CASE WHEN length(name) > 15 THEN substring(name, 1, 12) || '...' ELSE name END AS short_id
FROM (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part) x""",
    "demo_flag": with_(DIR, ROSTER) + """
SELECT 'empty_roster' AS input, NOT EXISTS (SELECT 1 FROM roster WHERE user_id IS NULL) AS is_demo
UNION ALL
SELECT 'roster', NOT EXISTS (SELECT 1 FROM roster)""",
    "submitted_clock": """
SELECT CAST(event_id AS VARCHAR) AS response_id, strftime(ts, '%H:%M:%S') AS clock FROM events""",
}

# the same results by another path
SQL |= {
    "submit_once": SQL["submit_append"],
    "stream_ungraded": SQL["ungraded_responses"],
    "roster_stream": SQL["roster_ingest"],
    "leaderboard_colocated": SQL["leaderboard"],
    "stream_live_board": SQL["stream_leaderboard"],
    "live_board_page": SQL["leaderboard_page"],
}
