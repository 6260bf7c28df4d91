"""The parser as functions of Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import quillmap
from quillmap.operators.mapper import detect_dialect, parse_bytes
from quillmap.sources.results_json import dumps


@F.pandas_udf("string")
def mapper_dialect(content: pd.Series) -> pd.Series:
    return content.map(lambda x: detect_dialect(x or b""))


@F.pandas_udf("string")
def mapper_json(content: pd.Series) -> pd.Series:
    return content.map(lambda x: dumps(parse_bytes(x or b"")))


@F.udtf(returnType="ord int, kind string, id string, text string, conditions array<string>")
class MapperVariants:
    """One row a variant of each statement: ``LATERAL mapper_variants(content)``."""

    def eval(self, content):
        mapper = parse_bytes(bytes(content or b""))["mapper"]
        for k, s in enumerate(mapper["statements"] if mapper else ()):
            sql = s["sql"]
            for v in sql["variants"] or [{"text": sql["union"]["text"], "conditions": []}]:
                yield k, s["kind"], s["id"] and s["id"]["value"], v["text"]["text"], v["conditions"]


def register(spark: SparkSession) -> None:
    """mapper_dialect(binary), mapper_json(binary), mapper_variants(binary), mapper_version()."""
    spark.udf.register("mapper_dialect", mapper_dialect)
    spark.udf.register("mapper_json", mapper_json)
    spark.udtf.register("mapper_variants", MapperVariants)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mapper_version() RETURN '{quillmap.__version__}'")
