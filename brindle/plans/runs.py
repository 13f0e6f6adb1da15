"""A directory, a log and files for one run."""

from __future__ import annotations

import csv
import json
import logging
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

import numpy as np

from brindle.plans.config import LOGGING, ConfigError


def run_directory(root: str | Path) -> Path:
    now = datetime.now(timezone.utc)
    out = Path(root) / f"run_{now:%Y%m%dT%H%M%S}_{now.microsecond:06d}Z_{uuid.uuid4().hex[:8]}"
    out.mkdir(parents=True)
    return out


def levels(settings: dict, console: str | None = None, file: str | None = None) -> dict:
    """The configured levels, with overrides of a command line."""
    out = {n: f.default for n, f in LOGGING.items()} | settings
    out |= {k: v.upper() for k, v in (("console_level", console), ("file_level", file)) if v}
    for name, value in out.items():
        if name not in LOGGING:
            raise ConfigError(f"unknown logging setting {name}")
        LOGGING[name].check(name, value)
    return out


@contextmanager
def logged(out: Path, settings: dict, name: str = "brindle") -> Iterator[logging.Logger]:
    """Sends the named logger to the console and to run.log while a run lasts, and puts all back after it.

    A failure is logged with its traceback and goes on, marked, so that it is not told twice.
    """
    log = logging.getLogger(name)
    before = (log.handlers, log.level, log.propagate)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s", "%Y-%m-%dT%H:%M:%SZ")
    form.converter = time.gmtime
    own = [logging.StreamHandler(), logging.FileHandler(out / "run.log", "x", encoding="utf-8")]
    for handler, key in zip(own, ("console_level", "file_level"), strict=True):
        handler.setFormatter(form)
        handler.setLevel(settings[key])
    log.handlers, log.propagate = own, False
    log.setLevel(min(h.level for h in own))
    try:
        log.info("Run directory: %s", out)
        yield log
    except BaseException as e:
        log.exception("The run failed; the log is %s", out / "run.log")
        e.in_run_log = True
        raise
    finally:
        log.handlers, level, log.propagate = before
        log.setLevel(level)
        for handler in own:
            handler.close()


def plain(x):
    """For JSON: NaN and infinities are null, numpy's numbers are Python's."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(path: Path, value) -> None:
    path.write_text(json.dumps(plain(value), indent=2, allow_nan=False, default=str) + "\n", encoding="utf-8")


def write_csv(path: Path, rows: list[dict], columns: list[str] | None = None) -> None:
    """One file with a header; null and NaN are blank."""
    names = columns or list(dict.fromkeys(k for r in rows for k in r))
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(names)
        for r in rows:
            r = plain(r)
            w.writerow(["" if r.get(n) is None else r[n] for n in names])
