"""Values that results depend on."""

# --- fixed values -----------------------------------------------------------
# Ingestion stages in order; ABANDONED is terminal and outside the order.
STAGES = ("NEW", "ARCHIVED", "STAGED", "CLEANED", "INSERTED", "COMPLETED")
ABANDONED = "ABANDONED"

LANDING_PREFIX = "raw/"

# Lake containers and the workspaces that mount them.
CONTAINERS = (
    "preprocess", "utilities", "raw", "archive", "source",
    "models", "snapshots", "orchestration", "dbt", "dbt-logs",
)
ANALYTICS_WRITES = ("utilities",)
ANALYTICS_READS = ("source", "models", "snapshots", "orchestration")

# Days after which an object moves to the tier.
LIFECYCLE_DAYS = {"cool": 1, "archive": 10, "delete": 30}
LOG_RETENTION_DAYS = 30
RECENT_DAYS = 3
ALERT_WINDOW = "15 minutes"
RUN_LIMIT_MINUTES = 20
LISTING_ATTEMPTS = 4
RETRY_SECONDS = 30

# Words a settings declaration may use as a type.
DECLARED_TYPES = ("str", "int", "num", "bool", "enum", "list", "map", "include", "ip", "null", "any")
# --- end of fixed values ----------------------------------------------------

ENTRY_KEYS = ("source", "table_name", "file_name", "increment")
