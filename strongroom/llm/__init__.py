"""Operators for training-data pipelines over large text tables.

Functions that run inside Python workers are shipped by value, so that a cluster needs the libraries they use but not
this package itself.
"""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

MODULES = (
    "common",
    "pieces",
    "toxicity",
    "warc",
    "license_scan",
    "secret_scan",
    "decontaminate",
    "ngram_join",
    "ppm",
    "fingerprint",
    "ring",
    "exact_dedup",
    "spelling",
    "periodic",
)

for _name in MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
