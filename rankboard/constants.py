"""Fixed values that must equal the reference application's for identical results.

FIXED VALUES (kept verbatim, in their natural order):
"""

# --- scoring ---------------------------------------------------------------
POINTS_PER_QUESTION = 10

# --- question bank: (id, question, options, correct_answer) ------------------
QUESTION_BANK = [
    (1, "What is the primary benefit of Delta Lake?",
     ["ACID transactions", "Schema evolution", "Time travel", "All of the above"],
     "All of the above"),
    (2, "Which format does Delta Lake use for storage?",
     ["JSON", "Parquet", "CSV", "Avro"],
     "Parquet"),
    (3, "What command is used to optimize Delta tables?",
     ["VACUUM", "OPTIMIZE", "COMPACT", "MERGE"],
     "OPTIMIZE"),
    (4, "Which SQL command allows you to see table history in Delta Lake?",
     ["SHOW HISTORY", "DESCRIBE HISTORY", "SELECT HISTORY", "TABLE HISTORY"],
     "DESCRIBE HISTORY"),
    (5, "What is the default retention period for Delta Lake time travel?",
     ["7 days", "30 days", "90 days", "365 days"],
     "30 days"),
]

# --- fallback roster when the directory yields nobody: (user_id, email, display_name, user_name)
DEFAULT_USERS = [
    ("1", "user1@example.com", "User One", "user1"),
    ("2", "user2@example.com", "User Two", "user2"),
    ("3", "user3@example.com", "User Three", "user3"),
]

# --- demo participants for the snapshot model: (id, display_name, email, username)
DEMO_PARTICIPANTS = [
    ("demo-user-1", "John Doe", "john.doe@company.com", "john.doe@company.com"),
    ("demo-user-2", "Jane Smith", "jane.smith@company.com", "jane.smith@company.com"),
    ("demo-user-3", "Bob Johnson", "bob.johnson@company.com", "bob.johnson@company.com"),
    ("demo-user-4", "Digital Workshop Admin", "admin@company.com", "admin@company.com"),
    ("demo-user-5", "Charlie Davis", "charlie.davis@company.com", "charlie.davis@company.com"),
]

# --- directory status labels and the demo-data marker -----------------------
STATUS_ACTIVE_LABEL = "✅ Active"
STATUS_DEMO_LABEL = "⚠️ Demo Data"
DEMO_MARKER = "⚠️"
STATUS_ACTIVE = "Active"
STATUS_INACTIVE = "Inactive"

# --- podium ------------------------------------------------------------------
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}          # else "#<rank>"
ROW_CLASSES = {1: "table-warning", 2: "table-light", 3: "table-info"}  # else ""
TIERS = {1: "gold", 2: "silver", 3: "bronze"}    # else "none"
HIGHLIGHT_TOP = 3                                # grid highlights index < 3

# --- answer feedback -----------------------------------------------------------
FEEDBACK_CORRECT = "Correct! ✅"
FEEDBACK_INCORRECT_PREFIX = "Incorrect. The correct answer is: "

# --- display / paging ------------------------------------------------------------
DISPLAY_LIMIT = 200
FALLBACK_DISPLAY_LIMIT = 20
PAGE_SIZE = 100
ID_TRUNCATE_OVER = 15
ID_TRUNCATE_KEEP = 12
ID_TRUNCATE_SUFFIX = "..."
CLOCK_FORMAT = "HH:mm:ss"

# --- table names (overridable by the caller) ---------------------------------------
USERS_TABLE = "eligible_users"
RESPONSES_TABLE = "user_responses"
LEADERBOARD_TABLE = "leaderboard"
SNAPSHOT_TABLE = "leaderboard_snapshot"
