"""Inputs of the catalogue's queries hold every row of their tables, also of larger tables than the local ones."""

import pytest

from stratasieve.plans import catalogue, inputs


@pytest.fixture
def lineitem(spark, tmp_path):
    """Lines of 30 orders, all in one image."""
    rows = [(o * 200, n, o * 3 + n, o + n, 1.0 * o, 1.0 * n) for o in range(30) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    return rows, str(tmp_path)


def test_replay_takes_all_orders(spark, lineitem):
    rows, folder = lineitem
    place, events = {}, []
    for order, _, part, supp, *_ in sorted(rows):
        layer = order // 200 % 6
        place[layer] = place.get(layer, -1) + 1
        op = "opaque" if part % 13 == 0 else "whiteout" if part % 7 == 0 else "put"
        events.append((layer, place[layer], op, f"{'etc' if part % 3 == 0 else 'app'}/d{supp % 3}", f"f{part % 5}", "symlink" if part % 17 == 0 else "regular"))
    live, deleted = {}, set()
    for layer, k, op, where, name, kind in sorted(events):
        gone = [p for p in live if p.startswith(where + "/")] if op == "opaque" else [p for p in (f"{where}/{name}",) if p in live]
        deleted |= {(p, *live.pop(p), f"l0-{layer}") for p in gone}
        if op == "put":
            live[f"{where}/{name}"] = (kind, f"l0-{layer}", k)
    deleted = {x for x in deleted if x[1] != "symlink"}
    final = {(p, *x) for p, x in live.items() if x[0] != "symlink"}
    assert inputs.rows(spark, folder, inputs.replay_rows).count() == len(rows)
    assert {tuple(r)[1:] for r in catalogue.QUERIES["replay_final"](spark, folder).collect()} == final
    assert {tuple(r)[1:] for r in catalogue.QUERIES["replay_deleted"](spark, folder).collect()} == deleted
    assert catalogue.QUERIES["replay_hardlinks"](spark, folder).count() > 0


@pytest.fixture
def customer(spark, tmp_path):
    """Customers on both sides of 100,000."""
    spark.range(99_990, 100_020).selectExpr("id as c_custkey", "concat('c', id) as c_name").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("table", ["repositories", "manifests", "repository_manifests", "tags", "findings", "finding_occurrences"])
def test_state_takes_all_customers(spark, customer, table):
    for part, not_in in (("old", 0), ("new", 1)):
        assert inputs.rows(spark, customer, inputs.state_rows(table, part)).count() == sum(k % 3 != not_in for k in range(99_990, 100_020))


def test_upsert_reaches_the_last_customer(spark, customer):
    got = {x["digest"] for x in catalogue.QUERIES["upsert_manifests"](spark, customer).collect()}
    assert got == {f"sha256:{k}" for k in range(99_990, 100_020)}
