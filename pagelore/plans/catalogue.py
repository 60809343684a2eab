"""All registered queries, one module per part of the inventory."""

import importlib

from . import registry

MODULES = ("scans", "filters", "joins", "aggregates", "windows", "topk", "sets", "scalars", "html",
           "chunks", "retrieval", "vectors", "graphs", "provenance", "streams", "udfs")

for _m in MODULES:
    try:
        importlib.import_module(f"{__package__}.{_m}")
    except ModuleNotFoundError as e:
        if not str(e.name).endswith(f".{_m}"):
            raise


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
