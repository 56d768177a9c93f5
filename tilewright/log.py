"""Logging: one handler on the package's logger."""

from __future__ import annotations

import logging
from pathlib import Path


def setup_logging(level: str | int = "INFO", filename: str | None = None) -> logging.Logger:
    """The package's logger with a console handler and, with ``filename``, a file; calling it again replaces them."""
    known = logging.getLevelNamesMapping()
    if isinstance(level, str) and level.upper() not in known:
        raise ValueError(f"unknown level {level!r}")
    logger = logging.getLogger("tilewright")
    for h in list(logger.handlers):
        logger.removeHandler(h)
    form = logging.Formatter("[%(asctime)s][%(name)s][%(levelname)s] %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if filename:
        Path(filename).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(filename))
    for h in handlers:
        h.setFormatter(form)
        logger.addHandler(h)
    logger.setLevel(known[level.upper()] if isinstance(level, str) else level)
    return logger
