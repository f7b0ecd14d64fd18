"""The data model: nested envelope type, enumerations and the arrival columns."""

from __future__ import annotations

# ---- fixed values ----------------------------------------------------------------------------
LEVELS = ("fatal", "error", "warning", "info", "debug")
STATUSES = ("unresolved", "resolved", "ignored")
EVENT_ID_PATTERN = "^[0-9a-f]{32}$"
DEFAULT_PLATFORM = "node"
DEFAULT_LEVEL = "error"
DEFAULT_PROJECT = "default"
DEFAULT_STATUS = "unresolved"
# ---- end of fixed values ---------------------------------------------------------------------

FRAME_TYPE = (
    "struct<function:string,filename:string,module:string,lineno:bigint,colno:bigint,"
    "in_app:boolean,context_line:string>"
)
EXCEPTION_VALUE_TYPE = f"struct<type:string,value:string,stacktrace:struct<frames:array<{FRAME_TYPE}>>>"
EXCEPTION_TYPE = f"struct<values:array<{EXCEPTION_VALUE_TYPE}>>"
BREADCRUMB_TYPE = (
    "struct<timestamp:double,category:string,message:string,level:string,data:variant>"
)
ENVELOPE_FIELDS = {
    "event_id": "string",
    "timestamp": "double",
    "platform": "string",
    "level": "string",
    "project": "string",
    "logger": "string",
    "release": "string",
    "environment": "string",
    "server_name": "string",
    "transaction": "string",
    "message": "string",
    "exception": EXCEPTION_TYPE,
    "tags": "map<string,string>",
    "breadcrumbs": f"array<{BREADCRUMB_TYPE}>",
    "extra": "variant",
}
ENVELOPE_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in ENVELOPE_FIELDS.items()) + ">"

# Canonical arrival order of deliveries.  `first` in this engine always means first by these.
ARRIVAL = ("received_us", "seq")
