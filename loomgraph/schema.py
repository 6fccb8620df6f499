"""Tables of a code graph, their vocabularies and the limits of parameters."""

from __future__ import annotations

LANGUAGES = ("c", "cpp", "csharp", "typescript", "javascript", "python", "rust", "java", "go", "bash", "sql", "yaml")
PARSE_STATUSES = ("ok", "partial", "failed", "skipped")
VISIBILITIES = ("public", "protected", "private")
REF_KINDS = ("call", "type_ref", "include", "inherit", "field_access", "other")
EDGE_KINDS = ("calls", "includes", "inherits", "references", "contains")
LEAST_CONFIDENCE = 0.3
ROOT_STRIDE = 1_000_000_000

TABLES = {
    "roots": "id bigint, path string, added_at string",
    "files": "id bigint, path string, language string, size_bytes bigint, mtime_ns bigint, content_hash string, parse_status string, parse_error string, root_id bigint",
    "nodes": "id bigint, node_type string, file_id bigint, kind string, name string, qualname string, signature string, start_line int, start_col int, end_line int, end_col int, is_definition int, visibility string, doc string, stable_key string",
    "refs": "id bigint, file_id bigint, kind string, name string, start_line int, start_col int, end_line int, end_col int, resolved_node_id bigint, evidence string, containing_node_id bigint, arg_count int, arg_pattern string, receiver_type_hint string",
    "edges": "id bigint, src_id bigint, dst_id bigint, kind string, confidence double, evidence string",
    "lines": "file_id bigint, line_no int, content string, full_line string",
    "kv": "key string, value string",
    "quarantine": "path string, crash_count int, first_crash string, last_crash string, error string",
}

SCANNED = "absolute_path string, relative_path string, language string, size_bytes bigint, mtime_ns bigint"

#: Per file: symbols, references and edges; indices are local to the file, -1 is the file itself.
EXTRACTED = (
    "path string, parse_status string, parse_error string, truncated boolean, "
    "symbols array<struct<kind string, name string, qualname string, signature string, start_line int, start_col int, end_line int, end_col int, visibility string, doc string>>, "
    "refs array<struct<kind string, name string, start_line int, start_col int, end_line int, end_col int, evidence string, containing int, arg_count int, arg_pattern string, receiver_type_hint string>>, "
    "edges array<struct<src int, dst int, kind string, confidence double, evidence string>>"
)


class GraphError(Exception):
    """An error with the code that JSON clients see."""

    code, error_code = -32603, "internal"


class NotFound(GraphError):
    code, error_code = -32000, "not_found"


class InvalidInput(GraphError):
    code, error_code = -32602, "invalid_input"


class QueryTimeout(GraphError):
    code, error_code = -32001, "query_timeout"


class StoreError(GraphError):
    code, error_code = -32002, "db_error"


class LimitExceeded(GraphError):
    code, error_code = -32003, "limit_exceeded"


def clamp(value: int | float | None, low: int | float, high: int | float, default: int | float) -> int | float:
    return default if value is None else max(low, min(high, value))
