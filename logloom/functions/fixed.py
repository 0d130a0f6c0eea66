"""Fixed values that decide results: names, codes, limits, markers.

They are part of the log format being read, so they must not be changed freely.
"""

# Severity names and their codes (0 is worst).
SEVERITY_CODES = {
    "emerg": 0,
    "emergency": 0,
    "alert": 1,
    "crit": 2,
    "critical": 2,
    "fatal": 2,
    "panic": 2,
    "err": 3,
    "error": 3,
    "warn": 4,
    "warning": 4,
    "notice": 5,
    "info": 6,
    "informational": 6,
    "log": 6,
    "debug": 7,
    "trace": 7,
    "verbose": 7,
}

# Labels of the severity codes, long and short.
SEVERITY_LABELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
SEVERITY_SHORT = ("EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")

# Level marks of Valkey/Redis server lines.
VALKEY_LEVELS = {"#": 4, "*": 5, ".": 7, "-": 7}

# Month names of BSD syslog and Valkey headers.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Limits and markers of stored text.
MAX_TEXT_CHARS = 65_536
MAX_IDENTITY_CHARS = 255
SYSLOG_CUT_MARK = " [truncated]"
SAMPLE_CUT_MARK = "... [truncated]"
BUDGET_CUT_NOTICE = "[... Truncated older logs to fit token budget ...]\n"
SEVERITY_HEADER_CHARS = 200
MESSAGE_KEY_CHARS = 150
SAMPLE_MAX_LINES = 5
SAMPLE_MAX_CHARS = 500
INCIDENT_SAMPLE_CHARS = 1_000
BUNDLE_MAX_CHARS = 100_000
REDACTED = "[REDACTED]"

# Time limits in seconds.
MAX_FUTURE_SECONDS = 300
MAX_PAST_SECONDS = 86_400

# Limits of one multi-line entry.
ENTRY_MAX_LINES = 500
ENTRY_MAX_BYTES = 262_144
ENTRY_MAX_SECONDS = 5.0
ENTRY_GAP_SECONDS = 0.150

# List and count limits of reports.
FACET_LIMIT = 500
API_COUNT_CAP = 1_001
NEWEST_MATCHES = 50
TERM_PREFIX_MIN_CHARS = 3

# Rule names that are not alert firings.
DIGEST_RULE_NAME = "Daily Digest"
ON_DEMAND_RULE_NAME = "On-Demand Analysis"

# The source address and default alias of container output.
CONTAINER_SOURCE = "docker"

# Hosts, apps and notes that a review header lists; the rest is counted.
HEADER_MAX_NAMES = 1000

# Texts of incident summaries.
STORM_HEAD = "Log storm detected: "
STORM_APP = " logs/s).\n\n### Primary Culprits\n- Top Service / App: "
STORM_HOST = "\n- Top Host / Source: "
STORM_MESSAGE = "\n- Top Pattern: "
PLAIN_HEAD, PLAIN_END = "Alert triggered with ", " matching event(s)."

# Texts of the daily digest.
DIGEST_HEAD = "### 24-Hour Analytical Rollup"
DIGEST_TOTAL = "- **Total Logs Ingested:** "
DIGEST_DELTA = "- **System Storage Delta:** "
DIGEST_ERRORS = "### Top Apps / Hosts with Errors or Above"
DIGEST_NO_ERRORS = "- No errors or critical events recorded in the last 24 hours."
DIGEST_SERVICES = "### Top Logging Services"
DIGEST_NO_SERVICES = "- No log activity recorded."
