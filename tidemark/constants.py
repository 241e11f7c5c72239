"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a contract value (limits, enum members, literal
texts); changing one changes results.
"""

# --- fixed values: limits -------------------------------------------------
FINGERPRINT_BODY_CHARS = 2000      # body prefix that enters the fingerprint
FINGERPRINT_HEX_CHARS = 16         # hex characters kept from the SHA-256 digest
MAX_CONTENT_LENGTH = 8000          # default body clip before enrichment
BODY_PREVIEW_CHARS = 10240         # stored body preview, in characters
DEFAULT_QUERY_LIMIT = 1000         # default page size of the query command
DEFAULT_RATE_LIMIT_RPM = 30        # default request rate (calls per minute)
QUARANTINE_DETAIL_CHARS = 150      # error text kept in a quarantine summary

# --- fixed values: triage result enum ------------------------------------
PRIORITIES = ["High", "Medium", "Low", "Spam", "Error"]
PRIORITY_UNPROCESSED = "Unprocessed"

# --- fixed values: defaults for keys missing from a model answer ---------
DEFAULT_PRIORITY = "Low"
DEFAULT_SUMMARY = "Failed to summarize"

# --- fixed values: lax boolean spellings accepted for action_required ----
# (compared after lower-casing; no trimming)
BOOL_TRUE_STRINGS = ["1", "on", "t", "true", "y", "yes"]
BOOL_FALSE_STRINGS = ["0", "off", "f", "false", "n", "no"]

# --- fixed values: constructed results ------------------------------------
SKIP_SUMMARY_PREFIX = "RAW: "
DRY_RUN_PRIORITY = "Medium"
DRY_RUN_SUMMARY_PREFIX = "Dry-run simulated summary for "
DRY_RUN_MISSING_SUBJECT = "No Subject"
DRY_RUN_ENTITIES = ["DryRunEntity"]
QUARANTINE_SUMMARY_PREFIX = "\U0001F525 [NLP FAULT] NLP parsing crashed: "
QUARANTINE_ERROR_PREFIX = "NLP failed: "
QUARANTINE_ENTITIES = ["NLP_CRITICAL_FAILURE", "QUARANTINE_WARNING"]

# --- fixed values: audit ---------------------------------------------------
AUDIT_SUCCESS = "SUCCESS"
AUDIT_FAIL = "FAIL"
AUDIT_NO_NEW = "No new emails"
AUDIT_EMIT_FAILED = "Output emit failed"

# --- fixed values: console report block ----------------------------------
REPORT_RULE = "=" * 70
REPORT_TITLE = "\U0001F4E7 EMAIL TRIAGE REPORT ["
REPORT_BANNER_HIGH = "\U0001F6A8 HIGH"
REPORT_BANNER_MEDIUM = "⚠️ MEDIUM"
REPORT_BANNER_SPAM = "\U0001F5D1️ SPAM"
REPORT_BANNER_OTHER = "ℹ️ LOW"
REPORT_UID = "UID: "
REPORT_TRUNCATED = "Truncated by AI Limits: "
REPORT_SUMMARY = "\U0001F4DD Summary:"
REPORT_ACTION = "\U0001F4A5 ACTION REQUIRED! This email needs human attention."
REPORT_NO_ACTION = "✅ No urgent human attention needed."
REPORT_ENTITIES = "\U0001F3F7️  Key Entities extracted:"
REPORT_ENTITY_BULLET = "  - "
REPORT_NO_ENTITIES = "  (No key entities found)"

# --- fixed values: fixed-width table output ------------------------------
TABLE_EMPTY = "No results."
TABLE_HEADER = "     ID    PRI | DATE             | SENDER                         | SUBJECT"
TABLE_RULE = "----------------------------------------------------------------------------"

# --- fixed values: layout of a model request (each line indented) ----------
REQUEST_INDENT = "\n        "
REQUEST_LABELS = ["Subject: ", "Sender: ", "Date: ", "Body:"]

# --- fixed values: cursor movement in the run report -----------------------
MOVEMENT = [" -> ", " (+", " emails)"]
