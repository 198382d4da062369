"""Replay computes its events once, and gives what a plain replay of random events gives."""

import random

from stratasieve import schema
from stratasieve.operators import replay as rep
from stratasieve.plans import catalogue


def plain(events):
    live, out = {}, set()
    for layer, entry, op, path, kind, link in events:
        name = f"L{layer}"
        gone = [p for p in live if path == "" or p.startswith(path + "/")] if op == "opaque" else [path] if path in live else []
        src = (name, entry)
        if op == "put" and kind == "hardlink":
            if link not in live:
                continue
            src = live[link][3:]
        for p in gone:
            x = live.pop(p)
            out |= {(p, *x, "deleted", name)} if x[0] != "symlink" else set()
        if op == "put":
            live[path] = (kind, name, entry, *src)
    return out | {(p, *x, "final", "") for p, x in live.items() if x[0] != "symlink"}


def test_random_events(spark):
    pick, entries, events = random.Random(5), [], []
    paths = [f"{d}{f}" for d in ("", "a/", "a/b/", "a/bc/", "c/") for f in "xyz"]
    for layer in range(4):
        for entry in range(150):
            op = pick.choices(["put", "whiteout", "opaque"], [12, 2, 1])[0]
            path, link, kind = pick.choice(paths), pick.choice(paths), pick.choice(["regular", "hardlink", "symlink"])
            where, _, name = path.rpartition("/")
            at = f"{where}/" if where else ""
            events.append((layer, entry, op, where if op == "opaque" else path, kind, link))
            entries.append((f"L{layer}", entry, {"put": path, "whiteout": f"{at}{rep.PREFIX}{name}", "opaque": at + rep.OPAQUE}[op], kind, link))
    layers = spark.createDataFrame([(m, n, f"L{n}", "") for m in ("m1", "m2") for n in range(4)], schema.MANIFEST_LAYERS)
    got = rep.replay(layers, spark.createDataFrame(entries, "layer_digest string, entry_idx int, path string, kind string, linkname string")).collect()
    for m in ("m1", "m2"):
        rows = [tuple(x)[1:] for x in got if x["manifest_digest"] == m]
        assert set(rows) == plain(events) and len(rows) == len(set(rows))


def test_events_are_computed_once(spark, tmp_path):
    spark.createDataFrame([(200, 1, 3, 1, 1.0, 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("replay_final", "replay_deleted", "replay_hardlinks"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number()") == 1
