"""Settings of a session: keys `spanlake.<name>` of the Spark configuration, read when a query is planned."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: max_expansion_terms: words that the patterns of a scored query may expand to.
#: strict_analysis: refuse queries on an index whose analysis differs from this library's.
DEFAULTS = {"max_expansion_terms": 65_536, "strict_analysis": False}


def setting(spark: SparkSession, name: str):
    default = DEFAULTS[name]
    text = spark.conf.get(f"spanlake.{name}", str(default))
    if isinstance(default, bool):
        if text.lower() not in ("true", "false", "on", "off"):
            raise ValueError(f"spanlake.{name} must be on or off")
        return text.lower() in ("true", "on")
    if int(text) < 1:
        raise ValueError(f"spanlake.{name} must be positive")
    return int(text)
