"""SQL-side functions: a node table function and an EWMA aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .digests import canonical_json
from .dom import parse_one
from .encoders import hashing_encoder
from .textdiff import change_percentage, diff_lines


@F.udtf(returnType="id int, parent int, last int, depth int, tag string, text string")
class HtmlNodes:
    """html_nodes(markup): one row per element, for use in LATERAL joins."""

    def eval(self, html: str):
        p = parse_one(html)
        for n in p["nodes"]:
            yield n["id"], n["parent"], n["last"], n["depth"], n["tag"], p["text"][n["t0"]:n["t1"]]


def ewma_udaf(alpha: float = 0.1):
    """Grouped aggregate over values ordered by a sort key. For bounded groups; operators.windows.ewma does
    the same for groups of any size."""

    @F.pandas_udf("double")
    def ewma(order: pd.Series, value: pd.Series) -> float:
        v = value.iloc[order.argsort(kind="stable")]
        return float(v.ewm(alpha=alpha, adjust=False).mean().iloc[-1])

    return ewma


def register_all(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql."""
    spark.udtf.register("html_nodes", HtmlNodes)
    for name, fn in (("canonical_json", canonical_json), ("change_percentage", change_percentage), ("diff_lines", diff_lines),
                     ("hashing_encoder", hashing_encoder), ("ewma", ewma_udaf())):
        spark.udf.register(name, fn)
