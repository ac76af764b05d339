"""The policy document: shape, offline rules, canonical form and hash."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..errors import PolicyError
from .rules import compile_rule

MAX_POLICY_BYTES = 1 << 20
MAX_PAGE_SIZE = 50000
DEFAULT_PAGE_SIZE = 5000
MAX_PREDICATE_BYTES = 4096


@dataclass(frozen=True)
class Field:
    """One field of the document: its type, when it is written, and what must hold for it.

    `written`: "set" whenever given, "nonzero" only if it differs from the type's zero value, "always" every time.
    `unique`: no two items of the list have the same name.
    """

    name: str
    kind: str
    written: str = "nonzero"
    holds: tuple[tuple[Callable[[Any], Any], str], ...] = ()
    unique: bool = False


def _within(low: int, high: int):
    return ((lambda v: low <= v <= high), f"is outside {low}..{high}")


def _one_of(*values: str):
    return ((lambda v: v in values), f"is none of {', '.join(values)}")


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


_FILLED = ((lambda v: v), "is empty")
_REFERENCE = ((lambda v: v.get("name") and v.get("key")), "needs a name and a key")
_EXPRESSION = (
    ((lambda v: v.strip()), "is blank"), ((lambda v: ";" not in v), "holds a semicolon"),
    ((lambda v: len(v.encode()) <= MAX_PREDICATE_BYTES), f"is longer than {MAX_PREDICATE_BYTES} bytes"),
)
_PAGE = _within(1, MAX_PAGE_SIZE)

# The document format, fields in canonical order.
SHAPES: dict[str, tuple[Field, ...]] = {
    "policy": (
        Field("determinism", "determinism", "always"), Field("defaults", "defaults", "set"),
        Field("steps", "[step", unique=True), Field("databases", "[database", "always", (_FILLED,)),
    ),
    "determinism": (Field("mode", "str", holds=(_one_of("PerRun", "Fixed"),)), Field("seedSecretRef", "keyref", "set")),
    "keyref": (Field("name", "str"), Field("key", "str", "always"), Field("optional", "bool", "set")),
    "defaults": (
        Field("pageSize", "int", holds=(_PAGE,)), Field("onNull", "str"), Field("onEmpty", "str"), Field("locale", "str"),
        Field("emailDomain", "str"),
    ),
    "step": (
        Field("name", "str", "always", (_FILLED,)), Field("configMapKeyRef", "keyref", "set", (_REFERENCE,)),
        Field("secretKeyRef", "keyref", "set", (_REFERENCE,)), Field("continueOnError", "bool"),
    ),
    "stepref": (Field("name", "str", "always"),),
    "database": (
        Field("name", "str"), Field("namePattern", "str", holds=((_compiles, "is no regular expression"),)),
        Field("optional", "bool"), Field("pre", "[stepref"), Field("post", "[stepref"), Field("tables", "[table", unique=True),
    ),
    "table": (
        Field("name", "str", "always", (_FILLED,)), Field("action", "str", holds=(_one_of("Anonymize", "Truncate"),)),
        Field("optional", "bool"), Field("primaryKey", "[str"), Field("ignore", "ignore", "set"),
        Field("columns", "[column", unique=True), Field("pageSize", "int", "set", (_PAGE,)),
    ),
    "ignore": (Field("where", "str", "always", _EXPRESSION),),
    "column": (
        Field("name", "str", "always", (_FILLED,)), Field("strategy", "str", "always"), Field("params", "params", "set"),
        Field("consistent", "bool", "set"), Field("onNull", "str"), Field("onEmpty", "str"),
    ),
    "params": (
        Field("locale", "str"), Field("domain", "str"), Field("ascii", "bool", "set"), Field("digits", "int", "set"),
        Field("from", "str"), Field("to", "str"), Field("format", "str"), Field("country", "str"),
        Field("length", "int", "set"), Field("case", "str"), Field("unique", "bool"), Field("min", "int", "set"),
        Field("max", "int", "set"), Field("maxLength", "int", "set"), Field("sentences", "int", "set"),
        Field("value", "str", "set"), Field("valueFrom", "keyref", "set"), Field("encoding", "str"),
        Field("keepPrefix", "int", "set"), Field("keepSuffix", "int", "set"), Field("maskChar", "str"),
    ),
}
# What must hold between the fields of one object: (shape, test, finding).
RELATIONS: tuple[tuple[str, Callable[[dict], Any], str], ...] = (
    ("determinism", lambda o: o.get("mode") != "Fixed" or _REFERENCE[0](o.get("seedSecretRef", {})),
     "a fixed mode needs a seed reference with name and key"),
    ("step", lambda o: ("configMapKeyRef" in o) != ("secretKeyRef" in o), "a step has one source"),
    ("database", lambda o: ("name" in o) != ("namePattern" in o), "a database has either a name or a namePattern"),
    ("table", lambda o: (o.get("action") == "Truncate") != ("columns" in o),
     "a table has column rules, or is truncated and has none"),
)
_SCALARS = {"str": str, "bool": bool, "int": int}
_ZERO = ("", 0, False, [])


class _Reader:
    """Walks a document along the shapes: what comes back is canonical, what is wrong gathers in `findings`."""

    def __init__(self) -> None:
        self.findings: list[str] = []

    def note(self, path: str, text: str) -> None:
        self.findings.append(f"{path}: {text}")

    def read(self, kind: str, value: Any, path: str) -> Any:
        if kind.startswith("["):
            items = [] if value is None else value
            if not isinstance(items, list):
                self.note(path, "must be a list")
                return []
            return [self.read(kind[1:], item, f"{path}[{i}]") for i, item in enumerate(items)]
        if kind in _SCALARS:
            if type(value) is not _SCALARS[kind]:
                self.note(path, f"must be of type {kind}")
                return _SCALARS[kind]()
            return value
        if not isinstance(value, dict):
            self.note(path, "must be an object")
            return {}
        return self.read_object(kind, value, path)

    def read_object(self, kind: str, value: dict, path: str) -> dict:
        if unknown := set(value) - {field.name for field in SHAPES[kind]}:
            self.note(path, f"{len(unknown)} unknown field(s)")
        result = {}
        for field in SHAPES[kind]:
            here, given = f"{path}.{field.name}", value.get(field.name)
            if given is None and field.written != "always":
                continue
            zero = [] if field.kind[0] == "[" else {} if field.kind in SHAPES else _SCALARS[field.kind]()
            item = self.read(field.kind, zero if given is None else given, here)
            if field.written == "nonzero" and item in _ZERO:
                continue
            for test, text in field.holds:
                if not test(item):
                    self.note(here, text)
            if field.unique and len(names := [i.get("name") for i in item]) > len(set(names)):
                self.note(here, "two entries share a name")
            result[field.name] = item
        for shape, test, text in RELATIONS:
            if shape == kind and not test(result):
                self.note(path, text)
        return result


def findings(spec: Any) -> tuple[dict, list[str]]:
    """The canonical form of a document, and everything that is wrong with it without looking at any data."""
    reader = _Reader()
    policy = reader.read("policy", spec, "policy")
    steps = {step.get("name") for step in policy.get("steps", [])}
    for d, database in enumerate(policy.get("databases", [])):
        here = f"policy.databases[{d}]"
        if {ref.get("name") for phase in ("pre", "post") for ref in database.get(phase, [])} - steps:
            reader.note(here, "refers to an unknown step")
        for t, table in enumerate(database.get("tables", [])):
            for c, column in enumerate(table.get("columns", [])):
                try:
                    compile_rule(column, policy.get("defaults"))
                except PolicyError as error:
                    reader.note(f"{here}.tables[{t}].columns[{c}]", error.message)
    return policy, reader.findings


def validate(spec: Any) -> dict:
    """The canonical form; raises with all findings."""
    policy, wrong = findings(spec)
    if wrong:
        raise PolicyError("; ".join(wrong))
    return policy


def decode(document: bytes | str | dict) -> tuple[dict, str]:
    """Read one policy document; return its canonical form and hash."""
    if isinstance(document, dict):
        spec = document
    else:
        data = document.encode() if isinstance(document, str) else document
        if len(data) > MAX_POLICY_BYTES:
            raise PolicyError("the policy is larger than 1 MiB")
        try:
            spec = json.loads(data)
        except ValueError:
            raise PolicyError("the policy is not a single JSON document") from None
    canonical = validate(spec)
    return canonical, policy_hash(canonical)


def canonical_json(spec: dict) -> str:
    text = json.dumps(_Reader().read("policy", spec, "policy"), ensure_ascii=False, separators=(",", ":"))
    for char in "<>&\u2028\u2029":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text


def policy_hash(spec: dict) -> str:
    """Hash of references only: resolved secrets and SQL bodies never enter the document."""
    return "sha256:" + hashlib.sha256(canonical_json(spec).encode()).hexdigest()


def page_size(table: dict, defaults: dict | None, option: int | None = None) -> int:
    """Table setting, else policy default, else the run's option, else 5000."""
    return table.get("pageSize") or (defaults or {}).get("pageSize") or option or DEFAULT_PAGE_SIZE
