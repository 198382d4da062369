"""Replay, state, references, metadata, snippets, sources, scan and streaming."""

import gzip
import hashlib
import io
import json
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from stratasieve import schema
from stratasieve.functions import references as ref
from stratasieve.functions import scalar
from stratasieve.operators import findings as fnd
from stratasieve.operators import metadata as meta
from stratasieve.operators import replay as rep
from stratasieve.operators import state
from stratasieve.plans import read_api, scan
from stratasieve.sources import config, layers, registry, store
from stratasieve.streaming import incremental

GH = "ghp_" + "a1B2c3D4e5F6a7B8c9D0e1F2a3B4c5D6e7F8"


def test_references():
    r = ref.parse("nginx")
    assert (r.registry, r.repository, r.identifier, r.repository_only) == ("docker.io", "library/nginx", "latest", True)
    r = ref.parse("Index.docker.io/a/b:1@sha256:x")
    assert (r.registry, r.repository, r.tag, r.digest) == ("docker.io", "a/b", "1", "sha256:x")
    assert ref.parse("localhost:5000/x").canonical == "localhost:5000/x:latest"
    assert ref.parse("ghcr.io/a/b").with_tag("2").identifier == "2"
    for bad in ("", "http://x", "a@", "a@b", "a:", "ghcr.io", "ghcr.io/"):
        with pytest.raises(ref.ReferenceError_):
            ref.parse(bad)
    assert ref.parse_platform("Linux/ARM64/v8") == ("linux", "arm64", "v8") and ref.parse_platform(" ") is None
    with pytest.raises(ValueError):
        ref.parse_platform("linux")


def test_reference_columns_agree(spark):
    raw = ["nginx", "a/b:1", "ghcr.io/a@sha256:1", "localhost/x", "x:", "http://a", "Reg.io:5/p/q:t", "docker.io", " "]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    for row in df.select("raw", *[c.alias(k) for k, c in ref.columns(F.col("raw")).items()]).collect():
        try:
            p = ref.parse(row["raw"])
            assert (row["registry"], row["repository"], row["tag"], row["digest"], row["canonical"]) == (p.registry, p.repository, p.tag, p.digest, p.canonical)
        except ref.ReferenceError_:
            assert row["registry"] is None


def test_settings():
    assert config.load({}).max_file_bytes == 1 << 20
    assert config.load({"STRATASIEVE_TAG_PAGE_SIZE": "7", "STRATASIEVE_PERSIST_RAW": "true"}).tag_page_size == 7
    for k, v in (("TAG_PAGE_SIZE", "0"), ("MAX_LAYER_BYTES", "-1"), ("HTTP_ATTEMPTS", "x"), ("PERSIST_RAW", "maybe")):
        with pytest.raises(ValueError):
            config.load({f"STRATASIEVE_{k}": v})


def model(events):
    """Replay as a sequential fold."""
    live, gone = {}, []
    for layer, entry, path, kind, link in events:
        base, parent = path.rsplit("/", 1)[-1], path.rsplit("/", 1)[0] if "/" in path else ""
        if base == ".wh..wh..opq":
            for p in [p for p in live if not parent or p.startswith(parent + "/")]:
                gone.append((p, *live.pop(p), layer))
        elif base.startswith(".wh."):
            p = (parent + "/" if parent else "") + base[4:]
            if p in live:
                gone.append((p, *live.pop(p), layer))
        else:
            src = (layer, entry)
            if kind == "hardlink":
                if link not in live:
                    continue
                src = live[link][2]
            if path in live:
                gone.append((path, *live.pop(path), layer))
            live[path] = (kind, (layer, entry), src)
    out = [(p, k, at, src, "") for p, (k, at, src) in live.items() if k != "symlink"]
    return sorted(out + [(p, k, at, src, by) for p, k, at, src, by in gone if k != "symlink"])


@pytest.mark.parametrize("links", [False, True])
def test_replay_against_a_fold(spark, links):
    rng = random.Random(5)
    entries, manifests, expected = [], [], {}
    for m in range(12):
        ev = []
        for layer in range(4):
            for e in range(8):
                path = rng.choice(["a", "d/a", "d/b", "d/e/a", ".wh.a", "d/.wh.b", "d/.wh..wh..opq", ".wh..wh..opq", "d/e/.wh..wh..opq"])
                kind = rng.choice(["regular", "regular", "symlink"] + ["hardlink"] * links) if ".wh." not in path else "regular"
                ev.append((layer, e, path, kind, rng.choice(["a", "d/a", "d/b", "zz"]) if kind == "hardlink" else ""))
        for layer, e, path, kind, link in ev:
            entries.append((f"L{m}-{layer}", e, path, kind, link, 0, "text", True, b"x"))
        manifests += [(f"m{m}", layer, f"L{m}-{layer}", "") for layer in range(4)]
        expected[f"m{m}"] = model(ev)
    got = rep.replay(spark.createDataFrame(manifests, schema.MANIFEST_LAYERS), spark.createDataFrame(entries, schema.LAYER_ENTRIES)).collect()
    have = {}
    for x in got:
        n = lambda d: int(d.rsplit("-", 1)[1])
        have.setdefault(x["manifest_digest"], []).append((x["path"], x["kind"], (n(x["layer_digest"]), x["entry_idx"]), (n(x["src_layer"]), x["src_entry"]), n(x["deleted_by"]) if x["deleted_by"] else ""))
    key = lambda t: tuple(map(str, t))
    for m, want in expected.items():
        assert sorted(have.get(m, []), key=key) == sorted(want, key=key)


def test_a_long_chain_of_hardlinks(spark):
    """Each entry links to the one before; the last dead target is no event."""
    entries = [("L", 0, "f0", "regular", "", 0, "text", True, b"x")] + [("L", k, f"f{k}", "hardlink", f"f{k - 1}", 0, "text", True, b"") for k in range(1, 300)] + [("L", 300, "f0", "hardlink", "nowhere", 0, "text", True, b"")]
    got = rep.replay(spark.createDataFrame([("m", 0, "L", "")], schema.MANIFEST_LAYERS), spark.createDataFrame(entries, schema.LAYER_ENTRIES)).collect()
    assert len(got) == 300 and {(x["src_layer"], x["src_entry"], x["state"]) for x in got} == {("L", 0, "final")}


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in files:
            i = tarfile.TarInfo(name)
            if isinstance(body, tuple):
                i.type, i.linkname = body
                t.addfile(i)
            else:
                i.size = len(body)
                t.addfile(i, io.BytesIO(body))
    return out.getvalue()


def test_layer_entries_and_classes():
    data = tar([("./a.txt", b"hello"), ("/b//c/../d", b"x\0y"), ("e.so", b"\x7fELF.."), ("f", b"\x01\x02\x03a"), ("big", b"z" * 50), ("l", (tarfile.SYMTYPE, "a.txt")), ("h", (tarfile.LNKTYPE, "./a.txt")), ("empty", b"")])
    got = {x["path"]: x for x in layers.entries(data, "none", config.Settings(max_file_bytes=10))}
    assert {p: x["content_class"] for p, x in got.items()} == {"a.txt": "text", "b/d": "binary_nul", "e.so": "binary_shared_object", "f": "binary_low_printable", "big": "oversize", "l": "", "h": "", "empty": "text"}
    assert got["h"]["linkname"] == "a.txt" and got["a.txt"]["content"] == b"hello" and got["b/d"]["content"] is None
    for kind, packed in (("gzip", gzip.compress(data)), ("zstd", __import__("zstandard").ZstdCompressor().compress(data))):
        assert [x["path"] for x in layers.entries(packed, kind, config.Settings(max_file_bytes=10))] == list(got)


def test_layer_limits_keep_what_was_read():
    data = tar([(f"f{i}", b"x" * 600) for i in range(40)])
    some = list(layers.entries(data, "none", config.Settings(max_layer_entries=3)))
    assert [x["kind"] for x in some] == ["regular"] * 3 + ["error"]
    assert list(layers.entries(data, "none", config.Settings(max_layer_bytes=4000)))[-1]["path"].startswith("limit")
    assert list(layers.entries(b"junk", "gzip"))[-1]["kind"] == "error" and list(layers.entries(b"", "foreign"))[-1]["kind"] == "error"


def test_snippets_lines_and_redaction(spark):
    text = "first\nsecond line with €uro SECRETVALUE tail\nthird"
    raw = text.encode()
    a = raw.index(b"SECRETVALUE")
    df = spark.createDataFrame([(raw, a, a + 11, "SECRETVALUE")], "content binary, a long, b long, v string")
    x = df.select(scalar.snippet(F.col("content"), F.col("v"), F.col("a"), F.col("b")).alias("s"), scalar.match_line(F.col("content"), F.col("a"), F.col("b")).alias("l"), scalar.line_number(F.col("content"), F.col("a")).alias("n"), scalar.redact(F.col("v")).alias("r"), scalar.snippet(F.col("content"), F.col("v"), F.lit(5), F.lit(3)).alias("bad")).first()
    assert x["s"] == raw[a - 24 : a].decode(errors="replace").strip() + " SECRETVALUE " + "tail\nthird" and x["l"] == "second line with €uro SECRETVALUE tail" and x["n"] == 2 and x["r"] == "SEC******UE" and x["bad"] == "SECRETVALUE"


def _findings(spark, n=5, **kw):
    base = dict(detector_name="keyword_entropy", confidence="low", disposition="actionable", disposition_reason="", source_type="file_final", manifest_digest="m", platform="linux/amd64", file_path="f", layer_digest="l", key="", line_number=1, redacted_value="r", fingerprint="fp", context_snippet="c", present_in_final_image=True, value="v", raw_snippet="raw", source_location="file_final:f", match_start=0, match_end=4) | kw
    rows = [base | {"match_start": i} for i in range(n)]
    kinds = {"line_number": "int", "match_start": "long", "match_end": "long", "present_in_final_image": "boolean"}
    return spark.createDataFrame([tuple(r[c] for c in fnd.DETAIL) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in fnd.DETAIL))


def test_cap(spark):
    got = sorted((x["match_start"], x["occurrence_count"], x["suppressed_occurrence_count"]) for x in fnd.cap_low_confidence(_findings(spark)).collect())
    assert got == [(0, 5, 2), (1, 0, 0), (2, 0, 0)]
    assert fnd.cap_low_confidence(_findings(spark, confidence="high")).count() == 5


def test_dedup(spark):
    assert fnd.dedup_detailed(_findings(spark).unionByName(_findings(spark, detector_name="zzz"))).count() == 5
    assert fnd.dedup_public(fnd.public(_findings(spark))).count() == 1
    assert fnd.persisted(_findings(spark)).where("value = '' and raw_snippet = ''").count() == 5


def test_config_flattening(spark):
    body = json.dumps({"author": " ", "config": {"Env": ["B=2", "A"], "Labels": {"k": "v"}, "Cmd": ["run", " "], "Volumes": {"/d": {}}}, "container_config": {"Hostname": "h"}, "history": [{"created_by": "x", "comment": " ", "author": "me"}]})
    cfg = meta.parse_configs(spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "id int, body string"))
    got = {(x["source_type"], x["key"], x["content"]) for x in meta.flatten(cfg.drop("body")).collect()}
    assert got == {("env", "A", "A"), ("env", "B", "B=2"), ("label", "k", "k=v"), ("history", "history[0].created_by", "x"), ("history", "history[0].author", "me"), ("config", "config.cmd[0]", "run"), ("config", "config.volumes", "/d"), ("config", "container_config.hostname", "h")}


def _layout(tmp_path):
    blobs = tmp_path / "blobs" / "sha256"
    blobs.mkdir(parents=True)

    def put(data):
        d = hashlib.sha256(data).hexdigest()
        (blobs / d).write_bytes(data)
        return "sha256:" + d

    gz = "application/vnd.oci.image.layer.v1.tar+gzip"
    one = put(gzip.compress(tar([("app/.env", f"T={GH}\n".encode()), ("keep.txt", b"plain"), ("app/tests/x", GH.encode())])))
    two = put(gzip.compress(tar([("app/.wh..env", b"")])))
    bad = put(b"broken")
    mans = []
    for arch, digests in (("amd64", [one, two]), ("arm64", [one, bad])):
        cfg = put(json.dumps({"os": "linux", "architecture": arch, "config": {"Env": [f"GITHUB_TOKEN={GH}"]}}).encode())
        m = put(json.dumps({"mediaType": meta.MANIFEST_TYPES[0], "config": {"digest": cfg}, "layers": [{"digest": d, "mediaType": gz} for d in digests]}).encode())
        mans.append({"mediaType": meta.MANIFEST_TYPES[0], "digest": m, "size": 1, "platform": {"os": "linux", "architecture": arch}})
    mans.append({"mediaType": meta.MANIFEST_TYPES[0], "digest": "sha256:0", "size": 1, "platform": {"os": "unknown", "architecture": "unknown"}})
    (tmp_path / "index.json").write_text(json.dumps({"manifests": mans}))
    return str(tmp_path)


def test_scan_a_layout(spark, tmp_path):
    root = _layout(tmp_path / "img")
    s = scan.scan_layout(spark, root).saved(str(tmp_path / "all"))
    got = {(x["source_type"], x["platform"], x["disposition"], x["file_path"]) for x in s.findings.where("detector_name = 'github_token'").collect()}
    assert got == {("env", "linux/amd64", "actionable", ""), ("env", "linux/arm64", "actionable", ""), ("file_deleted_layer", "linux/amd64", "actionable", "app/.env"), ("file_final", "linux/arm64", "actionable", "app/.env"), ("file_final", "linux/amd64", "example", "app/tests/x"), ("file_final", "linux/arm64", "example", "app/tests/x")}
    c = s.counts()
    # one secret in an environment and in a deleted file: one fingerprint, several findings
    assert c["manifest_count"] == 2 and c["failed_manifest_count"] == 1 and c["target_count"] == c["completed_target_count"] == 1 and s.status(c) == "partial" and s.exit_code() == 2
    assert s.findings.where("detector_name = 'github_token'").select("fingerprint").distinct().count() == 1
    assert {x["tag"] for x in s.tags.collect()} == {"latest"} and s.tags.count() == 2
    only = scan.scan_layout(spark, root, "linux/amd64").saved(str(tmp_path / "one"))
    assert only.manifests.count() == 1 and only.status() == "completed" and only.summary().first()["status"] == "scanned"

    st = store.Store(spark, str(tmp_path / "state"))
    zero = {f.name: 0 for f in schema.TABLES["scan_runs"] if f.dataType.simpleString() == "int"}
    run = spark.range(1).select(*[F.lit(v).alias(k) for k, v in zero.items()], F.lit("img").alias("requested_reference"), *[F.lit("").alias(k) for k in ("resolved_reference", "requested_digest", "mode", "error_message")], F.lit("completed").alias("status"), F.lit("{}").alias("result_json"), F.lit("2024-01-01").cast("timestamp").alias("scanned_at"))
    for day in (1, 2):
        at = F.lit(f"2024-01-0{day}").cast("timestamp")
        st.save("docker.io", "library/img", only.manifests, only.tags, only.findings, run.withColumn("scanned_at", at), at)
    t = st.tables()
    first, last = t["findings"].select("first_seen_at", "last_seen_at").first()
    assert (first.day, last.day) == (1, 2) and t["scan_runs"].count() == 2 and t["findings"].where("value <> ''").count() == 0
    listed = read_api.list_findings(t, "", "library/img", "all").collect()
    assert len(listed) == t["findings"].count() and sum(x["occurrence_count"] for x in listed) == t["finding_occurrences"].count()
    assert read_api.list_findings(t, "", "library/img").count() <= len(listed)
    summary, occ = read_api.get_finding(t, listed[0]["id"])
    assert summary.count() == 1 and occ.count() == listed[0]["occurrence_count"]
    assert read_api.list_scans(t, "docker.io", "library/img").count() == 2 and read_api.get_scan(t, 1).count() == 0
    assert state.delete_cascade(t, t["repositories"])["tags"].count() == 0
    path = store.write_findings_file(only.findings, str(tmp_path / "out"), "f.json")
    listed = json.loads(open(path).read())
    assert len(listed) == only.findings.count() and "value" not in listed[0] and oct(os.stat(path).st_mode)[-3:] == "600" and oct(os.stat(tmp_path / "out").st_mode)[-3:] == "700"
    assert [x["disposition"] for x in listed] == sorted((x["disposition"] for x in listed), key=lambda x: x != "actionable")
    assert store.NoStore().save() is None and store.result_json(only.findings).count() == only.findings.count()


def test_pages():
    assert read_api.disposition(None) == "actionable"
    for bad in ("x",):
        with pytest.raises(ValueError):
            read_api.disposition(bad)


def test_tag_and_manifest_records(spark):
    t = spark.createDataFrame([(["a", "b"], "r", [("d1", "linux", "amd64", "", "scanned", "")]), (["c"], "r2", [])], "tags array<string>, root_digest string, manifests array<struct<digest:string,os:string,architecture:string,variant:string,status:string,error:string>>")
    got = state.tag_records(t, spark.createDataFrame([("z", "no")], "tag string, error string"))
    assert {(x["tag"], x["manifest_digest"], x["status"]) for x in got.collect()} == {("a", "d1", "scanned"), ("b", "d1", "scanned"), ("c", "", "failed"), ("z", "", "failed")}
    m = spark.createDataFrame([("d", "", "", "", "", "failed", "e1", 1), ("d", "r", "linux", "", "", "", "", 2), (" ", "", "", "", "", "", "", 3)], "digest string, root_digest string, platform_os string, platform_architecture string, platform_variant string, status string, error string, ord int")
    (x,) = state.merge_manifests(m).collect()
    assert (x["root_digest"], x["platform_os"], x["status"], x["error"]) == ("d", "linux", "scanned", "")


def test_registry_client():
    calls = []

    def send(method, url, headers, timeout, most=0):
        calls.append((method, url, headers.get("Authorization")))
        if "auth.test" in url:
            return registry.Response(200, {}, b'{"token": "T"}')
        if headers.get("Authorization") != "Bearer T":
            return registry.Response(401, {"www-authenticate": 'Bearer realm="https://auth.test/token",service="s",scope="x"'}, b"")
        if "last=b" in url:
            return registry.Response(200, {}, b'{"tags": ["c", "a"]}')
        if "tags/list" in url:
            return registry.Response(200, {"link": '</v2/r/tags/list?last=b>; rel="next"'}, b'{"tags": ["b", " a ", ""]}')
        if method == "HEAD":
            return registry.Response(500, {}, b"")
        return registry.Response(200, {"docker-content-digest": "sha256:1", "content-type": "t"}, b"{}")

    c = registry.Client("ghcr.io", config.Settings(), send)
    assert c.list_tags("r") == ["a", "b", "c"]
    assert c.resolve("r", "a") == ("sha256:1", "t")
    assert sum("auth.test" in u for _, u, _ in calls) == 1 and sum(m == "HEAD" and bool(a) for m, _, a in calls) == 2
    with pytest.raises(registry.LimitError) as e:
        registry.Client("ghcr.io", config.Settings(max_repository_tags=2), send).list_tags("r")
    assert e.value.partial == ["a", "b"]
    with pytest.raises(registry.LimitError):
        registry.Client("ghcr.io", config.Settings(max_manifest_bytes=1), send).manifest("r", "a")
    assert registry.Client("docker.io").base == "https://registry-1.docker.io" and registry.Client("localhost:5").base == "http://localhost:5"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "env", "m", "linux/amd64", "", "", "K", False, f"K={GH}".encode()), (2, "env", "m", "linux/amd64", "", "", "K", False, b"nothing")], schema.CONTENT_ROWS)
    folder = str(tmp_path / "in")
    rows.write.parquet(folder)
    st = store.Store(spark, str(tmp_path / "state"))
    for _ in range(2):
        q = incremental.keep_up(spark, folder, st, str(tmp_path / "ck"), "docker.io", "library/img")
        q.awaitTermination(120)
        assert q.exception() is None
    assert st.table("findings").count() == 1 and st.table("finding_occurrences").count() >= 1
    assert read_api.list_findings(st.tables(), "", "library/img", "all").count() == 1
    first = st.table("findings").select("first_seen_at").first()[0]
    assert first.year >= 2024
    again = spark.range(1).select(st.batch_time("content-0").alias("t")).first()["t"]
    assert again == first
