"""Imports every module that registers queries."""

import importlib
import pkgutil

import mullion.plans as _plans

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _m != "load":
        importlib.import_module(f"mullion.plans.{_m}")
