"""All queries of this package and the pipeline at the repository top."""

import corpus_pipeline

from . import queries as _queries  # noqa: F401
from . import registry


def queries():
    return dict(registry.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(registry.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
