"""Progress of long jobs: a logger, and hooks that a caller may add.

    progress.hooks.append(lambda what, **numbers: print(what, numbers))

Reports are made in the driver, between steps; a hook must not change what it is told. Debugging is the
logger's level: logging.getLogger("navloom").setLevel(logging.DEBUG).
"""

from __future__ import annotations

import logging
from collections.abc import Callable

log = logging.getLogger("navloom")
hooks: list[Callable[..., None]] = []


def report(what: str, **numbers: object) -> None:
    """Tell the logger, at debug level, and every hook what has been done."""
    log.debug("%s %s", what, numbers)
    for hook in hooks:
        hook(what, **numbers)
