"""A SQL surface: ``SELECT d.id, r.* FROM docs d, LATERAL lint(d.text, 'doc') r``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="rule_id string, start bigint, end bigint, snippet string")
class Lint:
    def eval(self, text: str, profile: str = "general-writing"):
        from glyphloom.functions.analyze import analyze_bytes

        if text is None:
            return
        for h in analyze_bytes(text.encode(), profile)["hits"]:
            yield h["rule_id"], h["start"], h["end"], h["snippet"]


def register(spark: SparkSession, name: str = "lint") -> None:
    """Registers the table function.  For whole tables use ``analyze``: it reads in Arrow batches."""
    spark.udtf.register(name, Lint)
