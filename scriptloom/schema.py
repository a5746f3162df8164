"""Table layouts and the fixed values written into them."""

from __future__ import annotations

from pyspark.sql import types as T

# The business key of a script, and the columns of a registry row in order;
# `needs_review` is this library's own.
KEY = ["sql_file_name", "_stg_sql_file_md5"]

CLASS_KEYS = ["stmt_type", "object_type", "operation_type", "schema_name", "object_name"]

REGISTRY_COLUMNS = [
    "sql_file_name",
    "sql_body",
    "_stg_sql_file_name",
    "_stg_sql_file_load_ts",
    "_stg_sql_file_md5",
    "completion_worked",
    "completion_status",
    "completion_err_msg",
    "completion_response",
    *CLASS_KEYS,
    "target_sql",
    "target_object_type",
    "updated_ts",
    "needs_review",
]

# Audit constants of a successful insert ("None" is text, not null).
AUDIT_WORKED = "Yes"
AUDIT_STATUS = "Completed"
AUDIT_ERR_MSG = "None"

# Status of a script that could not be classified; its message is the reason.
FAILED_WORKED = "No"
FAILED_STATUS = "Failed"

# Fixed value: which staged paths are scripts. Matched against the whole path.
SCRIPT_PATTERN = ".*MS-SQL-Server-Script.*[.]sql"

# Row caps of one interactive run per step (None = no cap).
PREVIEW_LIMIT = 5
BATCH_LIMIT = 50
WORKLIST_LIMITS = {"table": 25, "function": 5, "view": None, "trigger": 5, "constraint": 10}

# Work-list name -> (object_type, operation_type), all of them DDL.
WORKLIST_KINDS = {
    "table": ("table", "create"),
    "function": ("function", "create"),
    "view": ("view", "create"),
    "trigger": ("trigger", "create"),
    "constraint": ("table", "alter"),
}

# Target kind recorded with a translation; the compatible values are in COMPAT_TARGET_KINDS.
TARGET_KINDS = {
    "table": "Table",
    "function": "Function",
    "view": "View",
    "trigger": "Task",
    "constraint": None,
}
COMPAT_TARGET_KINDS = {
    "table": "Table",
    "function": "Table",
    "view": "Table",
    "trigger": "Table",
    "constraint": "None",
}

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            {"updated_ts": T.TimestampType(), "needs_review": T.BooleanType()}.get(name, T.StringType()),
            name not in KEY,
        )
        for name in REGISTRY_COLUMNS
    ]
)

CHAT_SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
