"""Operators that promise DataFrame functions only have no Python in their plans or their modules' main path."""

import inspect
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import common, licenses, mixing, quality
from tests.llm.test_operators import docs, prose


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module", [quality, mixing, licenses])
def test_no_python_functions(module):
    assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|pyarrow|numpy|toPandas", inspect.getsource(module))


def test_plans(spark):
    rng = random.Random(1)
    d = docs(spark, [prose(rng, 60) for _ in range(30)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for df in (quality.op1_quality(d, labels), mixing.op8_mixing(d), licenses.op4_licenses(d)):
        assert not re.search("Python|Pandas|Arrow", plan(df))
    slots = plan(mixing.op8_mixing(d))
    assert "CartesianProduct" not in slots and "SortMergeJoin" in slots


def test_staged_tables_end_lineage(spark):
    df = common.staged(spark.range(3).withColumn("x", F.lit(1)), "test")
    assert "Range" not in plan(df) and df.count() == 3
    common.clear_staged(spark)
    assert not common._written
