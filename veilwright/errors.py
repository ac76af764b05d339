"""Failure classes. A message never carries row values, SQL text or credentials."""

from __future__ import annotations

from collections.abc import Iterator

TRANSIENT = "transient"
POLICY = "policy"
SCHEMA = "schema"
PERMISSION = "permission"
UNIQUE = "unique"

# Process exit code per failure class.
EXIT_CODES = {TRANSIENT: 1, POLICY: 10, SCHEMA: 11, PERMISSION: 12, UNIQUE: 13}


class AnonymizeError(Exception):
    """A failure whose class and text are safe to publish."""

    failure_class = TRANSIENT

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


class PolicyError(AnonymizeError):
    failure_class = POLICY


class SchemaError(AnonymizeError):
    failure_class = SCHEMA


class PermissionDenied(AnonymizeError):
    failure_class = PERMISSION


class UniqueError(AnonymizeError):
    failure_class = UNIQUE


class UncertainStep(PolicyError):
    """A SQL step started but its end was never recorded."""

    def __init__(self):
        super().__init__("an SQL step started but never finished on record; resolve it first")


# Spark error conditions that say the schema or the data, not the cluster, is at fault: trying again would not help.
_SCHEMA_CONDITIONS = (
    "TABLE_OR_VIEW_NOT_FOUND",
    "UNRESOLVED_COLUMN",
    "PATH_NOT_FOUND",
    "SCHEMA_NOT_FOUND",
    "DATATYPE_MISMATCH",
    "CAST_INVALID_INPUT",
    "CAST_OVERFLOW",
    "ARITHMETIC_OVERFLOW",
    "BINARY_ARITHMETIC_OVERFLOW",
    "DIVIDE_BY_ZERO",
    "REMAINDER_BY_ZERO",
    "NUMERIC_VALUE_OUT_OF_RANGE",
    "DECIMAL_PRECISION_EXCEEDS_MAX_PRECISION",
    "INVALID_ARRAY_INDEX",
    "INVALID_FRACTION_OF_SECOND",
    "DATETIME_OVERFLOW",
    "CANNOT_PARSE_TIMESTAMP",
    "MALFORMED_RECORD_IN_PARSING",
    "MALFORMED_CSV_RECORD",
    "NOT_NULL_ASSERT_VIOLATION",
    "PARSE_SYNTAX_ERROR",
    "INVALID_REGEXP_REPLACE",
    "USER_RAISED_EXCEPTION",
)
_PERMISSION_CONDITIONS = ("INSUFFICIENT_PERMISSIONS", "PERMISSION_DENIED")


def _conditions(error: BaseException) -> Iterator[str]:
    """Spark's error conditions of an error and of what caused it, the outermost first."""
    for name in ("getCondition", "getErrorClass"):
        reader = getattr(error, name, None)
        if callable(reader):
            try:
                yield reader() or ""
                break
            except Exception:  # a half-built JVM error must not hide the first failure
                continue
    # A failed write or task wraps what went wrong in it.
    origin = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    for _ in range(20):
        if origin is None:
            return
        try:
            yield origin.getCondition() or ""
        except Exception:  # not every JVM error has a condition
            pass
        try:
            origin = origin.getCause()
        except Exception:
            return


def classify(error: BaseException) -> tuple[str, str]:
    """Map any exception to (class, publishable message)."""
    if isinstance(error, AnonymizeError):
        return error.failure_class, error.message
    for condition in _conditions(error):
        if condition.startswith(_SCHEMA_CONDITIONS):
            return SCHEMA, f"Spark operation failed ({condition})"
        if condition.startswith(_PERMISSION_CONDITIONS):
            return PERMISSION, f"Spark operation failed ({condition})"
    return TRANSIENT, "Spark or I/O operation failed"
