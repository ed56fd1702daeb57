"""Log lines as JSON or as ``message | key=value``."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def _extra(record: logging.LogRecord) -> dict:
    return {k: v for k, v in vars(record).items() if k not in _OWN}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line | _extra(record), default=str)


class HumanFormatter(logging.Formatter):
    def __init__(self) -> None:
        super().__init__("%(asctime)s %(levelname)s %(name)s: %(message)s")

    def format(self, record: logging.LogRecord) -> str:
        extra = "".join(f" {k}={v}" for k, v in _extra(record).items())
        return super().format(record) + (" |" + extra if extra else "")


def configure(level: str = "INFO", file: str | None = None, kind: str = "human") -> logging.Logger:
    logger = logging.getLogger("gridspark")
    logger.setLevel(level.upper())
    logger.handlers.clear()
    logger.propagate = False
    for h in [logging.StreamHandler(), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        h.setFormatter(JsonFormatter() if kind == "json" else HumanFormatter())
        logger.addHandler(h)
    return logger
