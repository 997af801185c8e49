"""Declared table schemas. Column names and order are part of the contract."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    pairs = (line.split() for line in spec.strip().splitlines())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ASSET_REGISTRY = _struct(
    """
    element_handle string
    registration_id string
    original_path string
    original_bucket string
    original_view string
    file_name string
    file_extension string
    file_size_bytes bigint
    file_ctime timestamp
    file_mtime timestamp
    file_atime timestamp
    owner_uid string
    owner_login string
    nfs_mode_bits int
    current_location string
    current_aws_bucket string
    current_aws_key string
    current_aws_region string
    registered_at timestamp
    last_state_change timestamp
    source_md5 string
    destination_md5 string
    """
)

LIFECYCLE_EVENTS = _struct(
    """
    event_id string
    element_handle string
    registration_id string
    event_type string
    event_timestamp timestamp
    source_path string
    destination_path string
    aws_bucket string
    aws_key string
    file_size_bytes bigint
    file_atime timestamp
    file_mtime timestamp
    pipeline_run_id string
    function_name string
    triggered_by string
    success boolean
    error_message string
    checksum_value string
    config_snapshot string
    """
)

OFFLOAD_CONFIG = _struct(
    """
    config_key string
    config_value string
    updated_by string
    updated_at timestamp
    change_reason string
    """
)

CONFIG_CHANGE_LOG = _struct(
    """
    change_id string
    config_key string
    old_value string
    new_value string
    changed_by string
    changed_at timestamp
    change_reason string
    """
)

CATALOG = _struct(
    """
    handle string
    parent_path string
    name string
    extension string
    size bigint
    atime timestamp
    mtime timestamp
    ctime timestamp
    login_name string
    nfs_mode_bits int
    element_type string
    tag_offload_status string
    """
)

AUDIT = _struct(
    """
    timestamp timestamp
    protocol string
    operation string
    object_path string
    user_name string
    bytes bigint
    """
)

MANIFEST = _struct(
    """
    handle string
    reg_id string
    path string
    size bigint
    bucket string
    atime string
    mtime string
    """
)

# One row per object that a copy job handled.
COPY_RESULTS = _struct(
    """
    handle string
    source_md5 string
    destination_md5 string
    bytes_copied bigint
    status string
    error string
    metadata map
    """
)

# One row per object whose cold copy was looked up.
PROBE_RESULTS = _struct(
    """
    handle string
    status string
    error string
    """
)
