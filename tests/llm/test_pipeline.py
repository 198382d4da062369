"""The pipeline against brute force, stage by stage on each stage's own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_duplicates import bench_words, brute_components, brute_hits, brute_repeats, space_words


def test_stages_against_brute_force(spark, tmp_path, rng):
    word = lambda: f"w{rng.randrange(300)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(60), text(14)
    rows = [(i, text(rng.randrange(60, 140)), "en", rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(200 + k, rows[k][1] + " tail", "en", "a") for k in range(6)] + [(300 + k, text(30) + " " + passage + " " + text(30), "en", "b") for k in range(5)] + [(400, text(20) + " " + item + " " + text(20), "en", "a"), (500, None, "en", "a")]
    junk = [(600 + k, " ".join(f"{word()}###" for _ in range(60)), "en", "a") for k in range(60)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + junk], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0 if i >= 600 else 1, 0) for i, *_ in rows + junk], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / re.sub(r"\W", "-", name))
        stage(spark, docs, d).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen[name] = [(x["doc_id"], x["text"]) for x in docs.collect()]
        if name != "mixing":
            assert docs.columns == before.columns
    ids = {k: {i for i, _ in v} for k, v in seen.items()}
    assert not any(i >= 600 for i in ids["quality classifier"]) and {i for i, *_ in rows if i != 500} <= ids["quality classifier"]
    comp = brute_components(seen["quality classifier"], 80)
    assert ids["near-duplicates"] == {i for i, c in comp.items() if i == c}
    gone = brute_repeats(seen["near-duplicates"])
    left = {i: [w for k, w in enumerate(space_words(t)) if k not in gone.get((i, t), (set(), set()))[1]] for i, t in seen["near-duplicates"]}
    assert {i: space_words(t) for i, t in seen["repeated passages"]} == {i: w for i, w in left.items() if w or not gone.get((i, dict(seen["near-duplicates"])[i]))}
    assert sum("".join(passage.split()) in "".join((t or "").split()) for _, t in seen["repeated passages"]) == 1
    assert ids["benchmark decontamination"] == {i for i, t in seen["repeated passages"] if not brute_hits(t, [(1, item)])[1]} and 400 not in ids["benchmark decontamination"]
    mixed = docs.select("doc_id", "copies").collect()
    assert mixed and all(1 <= x["copies"] <= 3 for x in mixed) and {x["doc_id"] for x in mixed} <= ids["benchmark decontamination"]
    direct = corpus_pipeline.run(spark, d)
    assert sorted((x["doc_id"], x["copies"]) for x in direct.select("doc_id", "copies").collect()) == sorted((x["doc_id"], x["copies"]) for x in mixed)
    assert direct.where(F.col("source").isNull()).count() >= 0 and bench_words("a")
