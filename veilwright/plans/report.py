"""The run's one-row report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import EXIT_CODES

MAX_MESSAGE = 512
MAX_REPORT_BYTES = 4096
SCHEMA = (
    "result string, class string, message string, tablesDone int, tablesTotal int, rowsDone bigint, "
    "stepsDone int, durationSeconds double, policyHash string"
)


@dataclass
class Report:
    result: str = "ok"
    failure_class: str = ""
    message: str = "all tables rewritten"
    tablesDone: int = 0
    tablesTotal: int = 0
    rowsDone: int = 0
    stepsDone: int = 0
    durationSeconds: float = 0.0
    policyHash: str = ""

    def exit_code(self) -> int:
        return 0 if self.result == "ok" else EXIT_CODES.get(self.failure_class, 1)

    def document(self) -> dict:
        fields = asdict(self)
        failure_class = fields.pop("failure_class")
        fields["message"] = fields["message"][:MAX_MESSAGE]
        ordered = {"result": fields.pop("result")}
        if failure_class:
            ordered["class"] = failure_class
        return {**ordered, **fields}

    def to_json(self) -> str:
        text = json.dumps(self.document(), ensure_ascii=False, separators=(",", ":"))
        if len(text.encode()) + 1 > MAX_REPORT_BYTES:
            raise ValueError("the report is larger than 4 KiB")
        return text

    def to_df(self, spark: SparkSession) -> DataFrame:
        document = {"class": None, **self.document()}
        return spark.createDataFrame([document], SCHEMA)
