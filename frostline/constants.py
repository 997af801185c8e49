"""Names, defaults and formats that the data model prescribes."""

# Event types, in lifecycle order.
REGISTERED = "REGISTERED"
SCANNED = "SCANNED"
THRESHOLD_EVALUATED = "THRESHOLD_EVALUATED"
COPY_STARTED = "COPY_STARTED"
COPY_COMPLETED = "COPY_COMPLETED"
COPY_FAILED = "COPY_FAILED"
CHECKSUM_VERIFIED = "CHECKSUM_VERIFIED"
CHECKSUM_MISMATCH = "CHECKSUM_MISMATCH"
LOCAL_DELETE_REQUESTED = "LOCAL_DELETE_REQUESTED"
LOCAL_DELETED = "LOCAL_DELETED"
LOCAL_DELETE_FAILED = "LOCAL_DELETE_FAILED"
RECALLED = "RECALLED"
CONFIG_CHANGED = "CONFIG_CHANGED"

EVENT_TYPES = (
    REGISTERED,
    SCANNED,
    THRESHOLD_EVALUATED,
    COPY_STARTED,
    COPY_COMPLETED,
    COPY_FAILED,
    CHECKSUM_VERIFIED,
    CHECKSUM_MISMATCH,
    LOCAL_DELETE_REQUESTED,
    LOCAL_DELETED,
    LOCAL_DELETE_FAILED,
    RECALLED,
    CONFIG_CHANGED,
)

# Registry locations. LOCAL_DELETED and RECALLED are also event types.
LOCAL = "LOCAL"
BOTH = "BOTH"
AWS = "AWS"
UNKNOWN = "UNKNOWN"
OFFLOADED_LOCATIONS = (AWS, BOTH, LOCAL_DELETED)

# Location an event type leaves the asset in; other event types change nothing.
STATE_AFTER_EVENT = {
    REGISTERED: LOCAL,
    COPY_COMPLETED: BOTH,
    LOCAL_DELETED: LOCAL_DELETED,
    RECALLED: RECALLED,
}

# Allowed moves between locations; None is "not registered yet".
LEGAL_TRANSITIONS = (
    (None, LOCAL),
    (LOCAL, BOTH),
    (BOTH, LOCAL_DELETED),
    (LOCAL_DELETED, RECALLED),
    (RECALLED, BOTH),
    (BOTH, AWS),
)

# Configuration keys with their default values.
DEFAULT_CONFIG = {
    "atime_threshold_days": "60",
    "target_aws_bucket": "corp-cold-tier",
    "target_aws_region": "us-east-1",
    "target_aws_storage_class": "INTELLIGENT_TIERING",
    "source_paths": "/tenant/projects,/tenant/media",
    "auto_delete_local": "false",
    "dry_run": "true",
    "batch_size": "500",
    "verify_checksum": "true",
}
REQUIRED_CONFIG_KEYS = tuple(DEFAULT_CONFIG)
INT_CONFIG_KEYS = ("atime_threshold_days", "batch_size")
BOOL_CONFIG_KEYS = ("auto_delete_local", "dry_run", "verify_checksum")
LIST_CONFIG_KEYS = ("source_paths",)
DEFAULT_STORAGE_CLASS = "INTELLIGENT_TIERING"
SEED_USER = "system"
SEED_REASON = "Initial setup"

# Names written into events.
DISCOVER = "discover"
OFFLOAD = "offload_and_track"
PURGE = "verify_and_purge"
SCHEDULE = "SCHEDULE"
DRY_RUN_REGISTRATION = "dry-run"

# Catalog values.
FILE = "FILE"
TAG_COPIED = "COPIED"
TAG_PURGED = "PURGED"
NO_LOGIN = "unknown"

# Outcomes of the byte-moving jobs.
COPIED = "COPIED"
MISMATCH = "MISMATCH"
ERROR = "ERROR"
FOUND = "FOUND"
NOT_FOUND = "NOT_FOUND"

# Texts of notes and errors.
MISMATCH_ERROR = "Checksum mismatch after copy"
