"""Structured logs: JSON lines written on the driver, and read back as a table."""

from __future__ import annotations

import json
import logging
import traceback
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

# Keys of a line, and the attribute of a record that each is taken from.
FIELDS = {"level": "levelname", "logger": "name", "module": "module", "function": "funcName", "line": "lineno"}
SCHEMA = "timestamp timestamp, level string, logger string, message string, module string, function string, line int, exception string"


class JsonLines(logging.Handler):
    """Writes each record as one line to a file, or to the standard error stream.

    A line has the fixed keys, the time the record was made (UTC), the trace of an exception, and the caller's own
    fields; of equal keys the caller's win. Values that JSON cannot express are written as texts.
    """

    def __init__(self, path: str | None = None):
        super().__init__()
        self.sink = logging.FileHandler(path, encoding="utf-8", delay=True) if path else logging.StreamHandler()
        self.sink.setFormatter(logging.Formatter("%(message)s"))

    @staticmethod
    def fields(record: logging.LogRecord) -> dict:
        made = datetime.fromtimestamp(record.created, timezone.utc)
        fixed = {key: getattr(record, attribute) for key, attribute in FIELDS.items()}
        trace = {"exception": "".join(traceback.format_exception(record.exc_info[1])).rstrip()} if record.exc_info and record.exc_info[1] else {}
        return {"timestamp": made.isoformat(), "message": record.getMessage(), **fixed, **trace, **record.__dict__.get("fields", {})}

    def emit(self, record: logging.LogRecord) -> None:
        try:
            line = json.dumps(self.fields(record), ensure_ascii=False, default=str)
            self.sink.emit(logging.makeLogRecord({"msg": line}))
        except Exception:  # noqa: BLE001 - a log never stops its caller
            self.handleError(record)

    def close(self) -> None:
        self.sink.close()
        super().close()


def get_logger(name: str, level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger with one :class:`JsonLines` sink however often it is asked for."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not any(isinstance(h, JsonLines) for h in logger.handlers):
        logger.addHandler(JsonLines(path))
        logger.propagate = False
    return logger


def log(logger: logging.Logger, level: int, message: str, /, **fields) -> None:
    logger.log(level, message, extra={"fields": fields}, stacklevel=2)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines of log files as a table of the fixed keys; lines that are no JSON are left out."""
    lines = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return lines.where("level is not null").drop("_corrupt")
