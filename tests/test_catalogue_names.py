"""A query reads its inputs by the module's names when it runs, so a name that is defined again changes it."""

import ast
import inspect
from collections import Counter

from stratasieve.plans import catalogue, inputs


def test_no_name_is_defined_twice():
    for module in (catalogue, inputs):
        names = Counter(x.name for x in ast.parse(inspect.getsource(module)).body if isinstance(x, (ast.FunctionDef, ast.ClassDef)))
        assert [n for n, times in names.items() if times > 1] == []


def test_tag_records_reads_orders(spark, tmp_path):
    spark.createDataFrame([(7, 1), (10, 1), (14, 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((x["tag"], x["root_digest"], x["manifest_digest"], x["status"]) for x in catalogue.QUERIES["tag_records"](spark, str(tmp_path)).collect())
    scanned = [(t, "sha256:1", f"sha256:1-{n}", "scanned") for t in ("t14", "t7", "u0") for n in (1, 2)]
    assert got == sorted([*scanned, ("t10", "", "", "failed")])
