"""Spark-native anonymization of relational datasets under a declarative policy."""

from .functions.digest import Keyring, fresh_seed
from .operators.apply import TableTransform, transform, violation_counts
from .operators.unique import resolve_unique, transform_unique
from .plans.policy import decode, policy_hash, validate
from .plans.preflight import PreflightOptions, preflight
from .plans.rules import STRATEGIES, Rule, compile_rule, parse_legacy
from .plans.runner import Run, RunOptions
from .plans.schema import ColumnInfo, TableInfo, table_info
from .sources.dataset import Catalog, Dataset, Folder, Jdbc, Tables

__all__ = [
    "Catalog", "ColumnInfo", "Dataset", "Folder", "Jdbc", "Keyring", "PreflightOptions", "Rule", "Run",
    "RunOptions", "STRATEGIES", "TableInfo", "TableTransform", "Tables", "compile_rule", "decode", "fresh_seed",
    "parse_legacy", "policy_hash", "preflight", "resolve_unique", "table_info", "transform", "transform_unique",
    "validate", "violation_counts",
]
