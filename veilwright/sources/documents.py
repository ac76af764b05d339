"""JSON documents and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTER_SCHEMA = """
name string, destination string, schemaVersion int, publishedAt string,
publishedBy struct<kind: string, namespace: string, name: string, uid: string>,
sourceCluster struct<name: string, namespace: string, crVersion: string>,
backup struct<storageName: string, completedAt: string, state: string>,
s3 struct<bucket: string, endpointUrl: string, region: string>,
anonymized struct<run: string, policy: string, policyHash: string>,
publicURL string, _corrupt_record string
"""
POINTER_VERSION = 2
LOG_SCHEMA = (
    "msg string, db string, table string, step string, name string, "
    "tablesDone int, tablesTotal int, rowsDone bigint, stepsDone int, _corrupt_record string"
)
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

_DESTINATION = (
    r"^s3://[^/@?#%:\s\x00-\x1f\x7f]+(:[0-9]*)?/"
    r"(?:[^?#%\x00-\x1f\x7f]|%[0-9A-Fa-f]{2})+#?\z"
)
_HTTP_URL = r"^https?://[^/@?#%\s\x00-\x1f\x7f]+(/[^?#\x00-\x1f\x7f]*)?\z"
_HTTPS_URL = r"^https://[^/@?#%\s\x00-\x1f\x7f]+(/[^#\x00-\x1f\x7f]*)?\z"


_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def one_document(text: Column) -> Column:
    """True where the text is one JSON value and nothing more.

    It must parse as the only item of a list and as the only member of an object: what stands behind the value would have to
    close both a bracket and a brace first.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    member = F.from_json(F.concat(F.lit('{"d":'), text, F.lit("}")), "d string")
    return F.coalesce((F.size(items) == 1) & member["d"].isNotNull(), F.lit(False))


def moment(text: Column) -> Column:
    """An RFC 3339 time, or NULL where the text is none."""
    return F.when(text.rlike(_RFC3339), text.try_cast("timestamp"))


def _time_or_absent(text: Column) -> Column:
    return text.isNull() | moment(text).isNotNull()


def valid_destination(destination: Column) -> Column:
    """An s3 bucket and object, without user, query or fragment."""
    return F.coalesce(destination.rlike(_DESTINATION), F.lit(False))


def read_pointers(texts: DataFrame, text: str = "value") -> DataFrame:
    """Decode pointer documents: adds `document` and `valid`.

    A missing version means 1. Optional addresses and times are checked where given, and no
    text may follow the document.
    """
    parsed = texts.withColumn("document", F.from_json(F.col(text), POINTER_SCHEMA, _STRICT))
    version = F.coalesce("document.schemaVersion", F.lit(1))
    parsed = parsed.withColumn("document", F.col("document").withField("schemaVersion", version))
    endpoint, public = F.coalesce("document.s3.endpointUrl", F.lit("")), F.coalesce("document.publicURL", F.lit(""))
    valid = (
        F.col("document._corrupt_record").isNull()
        & one_document(F.col(text))
        & _time_or_absent(F.col("document.publishedAt"))
        & _time_or_absent(F.col("document.backup.completedAt"))
        & (F.coalesce("document.name", F.lit("")) != "")
        & valid_destination(F.col("document.destination"))
        & (version >= 1)
        & ((endpoint == "") | endpoint.rlike(_HTTP_URL))
        & ((public == "") | public.rlike(_HTTPS_URL))
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def write_pointers(pointers: DataFrame, document: str = "document") -> DataFrame:
    """Adds `json`: the document as version 2; NULL where it is not valid."""
    current = F.col(document).dropFields("_corrupt_record").withField("schemaVersion", F.lit(POINTER_VERSION))
    return pointers.withColumn("json", F.when(F.col("valid"), F.to_json(current)))


def parse_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """Log lines as fields; lines that are not JSON objects are dropped."""
    parsed = lines.withColumn("entry", F.from_json(F.col(text), LOG_SCHEMA, _STRICT))
    # A broken line keeps its text in the corrupt-record field; an object without `msg` says nothing.
    keep = [c for c in lines.columns if c != text]
    fields = [
        F.col(f"entry.{name}").alias(name) if name.startswith("msg") else
        F.coalesce(f"entry.{name}", F.lit("")).alias(name) if name in ("db", "table", "step", "name") else
        F.coalesce(f"entry.{name}", F.lit(0)).alias(name)
        for name in ("msg", "db", "table", "step", "name", "tablesDone", "tablesTotal", "rowsDone", "stepsDone")
    ]
    good = F.col("entry._corrupt_record").isNull() & F.col("entry.msg").isNotNull() & one_document(F.col(text))
    return parsed.where(good).select(*keep, *fields)
