"""The registered queries: each a DataFrame pipeline over the driver's tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil

from marram import plans
from marram.plans import registry

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"marram.plans.{_m.name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
