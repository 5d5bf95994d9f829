"""Named queries over the driver tables; importing a module registers its queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name != "registry":
            importlib.import_module(f"{__name__}.{m.name}")
