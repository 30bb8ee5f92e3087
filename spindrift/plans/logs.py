"""Logs of a run: events as lines of text or JSON, and a copy of the console in a file."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import sys
import time
from collections.abc import Iterator

#: Forms of the log.
FORMATS = ("text", "jsonl")
log = logging.getLogger("spindrift")


class JsonLines(logging.Formatter):
    """One JSON object a line: an event as it is, any other message with its time, level and logger."""

    def format(self, record: logging.LogRecord) -> str:
        entry = getattr(record, "entry", None) or {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(record.created)), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(entry, ensure_ascii=False, default=str)


def configure(form: str | None = None, level: int = logging.INFO, stream=None) -> None:
    """Log to ``stream`` (stderr) in the form that is named, else in that of LOG_FORMAT; earlier handlers are replaced."""
    chosen = (form or os.environ.get("LOG_FORMAT") or "text").lower()
    if chosen not in FORMATS:
        raise ValueError(f"LOG_FORMAT is {chosen}, not one of {', '.join(FORMATS)}")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines() if chosen == "jsonl" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level)
    log.propagate = False


@contextlib.contextmanager
def configured(form: str, level: int = logging.INFO, stream=None) -> Iterator[None]:
    """The form of the log while this lasts; then it is as before."""
    before = (log.handlers[:], log.level, log.propagate)
    configure(form, level, stream)
    try:
        yield
    finally:
        log.handlers[:], log.propagate = before[0], before[2]
        log.setLevel(before[1])


def event(name: str, /, **fields) -> None:
    """An event of the run with its fields."""
    entry = {"event": name, "ts": time.strftime("%Y-%m-%dT%H:%M:%S"), **fields}
    log.info("[%s] %s", name, ", ".join(f"{k}={v}" for k, v in fields.items()), extra={"entry": entry})


class Tee:
    """Writes to several streams; says of itself what the first one says."""

    def __init__(self, *streams):
        self.streams = streams

    def write(self, text: str) -> int:
        for s in self.streams:
            s.write(text)
            s.flush()
        return len(text)

    def flush(self) -> None:
        for s in self.streams:
            s.flush()

    def isatty(self) -> bool:
        return self.streams[0].isatty()


@contextlib.contextmanager
def console_copied(path: str, stdout=None, stderr=None) -> Iterator[str]:
    """While this lasts, what goes to stdout and stderr goes to the file of the driver as well."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    out, err = sys.stdout, sys.stderr
    with open(path, "w", encoding="utf-8", buffering=1) as f:
        sys.stdout, sys.stderr = Tee(stdout or out, f), Tee(stderr or err, f)
        try:
            yield path
        finally:
            sys.stdout, sys.stderr = out, err
