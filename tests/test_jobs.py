"""Scans from a registry to saved state, against a registry that a thread serves."""

import gzip
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from stratasieve import __main__ as cli
from stratasieve.operators import detect as det
from stratasieve.operators import metadata as meta
from stratasieve.operators import rules, state
from stratasieve.plans import jobs, read_api
from stratasieve.sources import registry as reg
from stratasieve.sources import store
from stratasieve.sources.config import Settings
from test_operators import GH, tar

GZ = "application/vnd.oci.image.layer.v1.tar+gzip"


def at():
    return F.lit("2024-05-01").cast("timestamp")


class Registry:
    """Two images under four tags, one of them without an answer."""

    def __init__(self) -> None:
        self.blobs, self.manifests, self.tags, self.asked = {}, {}, {}, []
        one = self.put(gzip.compress(tar([("app/.env", f"T={GH}\n".encode()), ("keep.txt", b"plain")])))
        many = self.put(gzip.compress(tar([(f"f{k}", b"x") for k in range(9)])))
        small, large = self.image([one], {"Env": [f"GITHUB_TOKEN={GH}"]}), self.image([many], {"Env": ["A=b"]})
        broken = self.image([self.put(b"no archive")], {})
        self.tags = {"a": small, "b": small, "z": large, "m": broken, "gone": "sha256:0"}

    def put(self, data: bytes) -> str:
        digest = "sha256:" + hashlib.sha256(data).hexdigest()
        self.blobs[digest] = data
        return digest

    def image(self, layers: list[str], config: dict) -> str:
        cfg = self.put(json.dumps({"os": "linux", "architecture": "amd64", "config": config}).encode())
        body = json.dumps({"mediaType": meta.MANIFEST_TYPES[0], "config": {"digest": cfg}, "layers": [{"digest": d, "mediaType": GZ} for d in layers]}).encode()
        digest = "sha256:" + hashlib.sha256(body).hexdigest()
        self.manifests[digest] = body
        return digest

    def answer(self, path: str) -> tuple[int, dict, bytes]:
        self.asked.append(path)
        parts = path.partition("?")[0].split("/")
        if parts[-2:] == ["tags", "list"]:
            return 200, {}, json.dumps({"tags": sorted(self.tags)}).encode()
        if parts[-2] == "manifests":
            digest = self.tags.get(parts[-1], parts[-1])
            if digest in self.manifests:
                return 200, {"Docker-Content-Digest": digest, "Content-Type": meta.MANIFEST_TYPES[0]}, self.manifests[digest]
        if parts[-2] == "blobs" and parts[-1] in self.blobs:
            return 200, {}, self.blobs[parts[-1]]
        return 404, {}, b"{}"


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(reg, "REQUESTS", 2)


@pytest.fixture(scope="module")
def served():
    registry = Registry()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, headers, body = registry.answer(self.path)
            self.send_response(status)
            for k, v in (headers | {"Content-Length": str(len(body))}).items():
                self.send_header(k, v)
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield registry, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def github(run):
    return run.scan.findings.where("detector_name = 'github_token' and disposition = 'actionable'").count()


def test_a_repository_from_tags_to_state(spark, served, tmp_path):
    registry, url = served
    st = store.Store(spark, str(tmp_path / "state"))
    run = jobs.scan_and_save(spark, "ghcr.io/org/img", st, str(tmp_path / "w"), at(), Settings(registry_base_url=url))
    c = run.counts
    assert (c["tags_enumerated"], c["tags_resolved"], c["tags_failed"]) == (5, 4, 1)
    assert (c["target_count"], c["completed_target_count"], c["failed_target_count"], c["manifest_count"]) == (3, 2, 1, 3)
    assert run.status == "partial" and run.error == "" and run.exit_code() == 2 and github(run) == 2
    # the image under two tags is fetched once
    layer = "sha256:" + hashlib.sha256(registry.blobs[next(iter(registry.blobs))]).hexdigest()
    assert sum(x.endswith(f"blobs/{layer}") for x in registry.asked) == 1
    t = st.tables()
    tags = {(x["tag"], x["status"]) for x in t["tags"].collect()}
    assert tags == {("a", "scanned"), ("b", "scanned"), ("z", "scanned"), ("m", "failed"), ("gone", "failed")}
    row = t["scan_runs"].first()
    assert row["status"] == "partial" and row["tags_failed"] == 1 and json.loads(row["result_json"])["target_count"] == 3 and row["mode"] == "repository"
    assert read_api.list_findings(t, "ghcr.io", "org/img").count() == c["unique_fingerprints"] > 0 and read_api.list_scans(t, "ghcr.io", "org/img").count() == 1


def test_limits_end_a_run_and_keep_what_came_before(spark, served, tmp_path):
    _, url = served
    run = jobs.run_scan(spark, "ghcr.io/org/img", str(tmp_path / "a"), Settings(registry_base_url=url, max_repository_targets=2))
    assert run.limit and run.status == "partial" and run.counts["target_count"] == 3 and run.counts["manifest_count"] == 0 and run.exit_code() == 1
    run = jobs.run_scan(spark, "ghcr.io/org/img", str(tmp_path / "c"), Settings(registry_base_url=url, max_layer_entries=1))
    # the first target meets the limit: of the others nothing is kept
    assert run.limit and {x["first_tag"] for x in run.scan.targets.collect()} == {"a"} and run.counts["manifest_count"] == 1


def test_a_reference_without_an_answer(spark, served, tmp_path):
    _, url = served
    run = jobs.run_scan(spark, "ghcr.io/org/img:nowhere", str(tmp_path / "c"), Settings(registry_base_url=url))
    assert run.status == "failed" and "404" in run.error and run.exit_code() == 1


def test_command_line(spark, served, tmp_path, capsys):
    _, url = served
    env = {"STRATASIEVE_REGISTRY_BASE_URL": url, "STRATASIEVE_FINDINGS_DIR": str(tmp_path / "out"), "STRATASIEVE_STATE_DIR": str(tmp_path / "state")}
    assert cli.main(["scan", "ghcr.io/org/img:a", "--format", "json"], spark, env) == 2
    got = json.loads(capsys.readouterr().out)
    assert got["mode"] == "reference" and got["status"] == "completed" and got["tags_resolved"] == 1 and got["resolved_reference"].startswith("ghcr.io/org/img@sha256:")
    assert got["total_findings"] == len(got["findings"]) >= 2 and "value" not in got["findings"][0]
    (path,) = (tmp_path / "out").iterdir()
    assert len(json.loads(path.read_text())) >= 2
    assert cli.main(["scan", "http://x"], spark, env) == 1


def test_a_save_that_dies_keeps_the_old_state(spark, tmp_path, monkeypatch):
    st = store.Store(spark, str(tmp_path / "state"))
    m = spark.createDataFrame([("sha256:1", "sha256:1", "linux", "amd64", "", "scanned", "")], "digest string, root_digest string, platform_os string, platform_architecture string, platform_variant string, status string, error string")
    tags = spark.createDataFrame([], "tag string, manifest_digest string, root_digest string, platform_os string, platform_architecture string, platform_variant string, status string, error string")
    none = jobs.plan.detect_findings(spark.createDataFrame([], "source_type string, manifest_digest string, platform string, file_path string, layer_digest string, key string, present_in_final_image boolean, content binary"))
    st.save("ghcr.io", "a/b", m, tags, none, None, at())
    before = st.current()
    with monkeypatch.context() as mp:
        mp.setattr(st, "_create", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            st.save("ghcr.io", "a/c", m, tags, none, None, at())
    assert st.current() == before and st.table("repositories").count() == 1
    # a version that was cut off while it was written is passed over, by readers and by the next save
    assert store.Store._create(st, f"versions/{before[0] + 1:012d}", '{"repos')
    assert st.current() == before
    st.save("ghcr.io", "a/c", m, tags, none, None, at())
    assert st.table("repositories").count() == 2
    # a writer that has been overtaken is told so
    real = st._versions
    with monkeypatch.context() as mp:
        mp.setattr(st, "_versions", lambda: [v for v in real() if v < max(real())])
        with pytest.raises(store.Conflict):
            st.save("ghcr.io", "a/d", m, tags, none, None, at())
    st.compact()
    assert st.table("repositories").count() == 2 and st.table("manifests").count() == 1
    with pytest.raises(store.InvalidRecord):
        st.save("ghcr.io", "a/d", m.withColumn("status", F.lit("odd")), tags, none, None, at())
    with pytest.raises(store.InvalidRecord):
        st.save(" ", "a/d", m, tags, none, None, at())


def test_a_users_own_rules(spark):
    rows = spark.createDataFrame([(1, "key is acme-12345678 here", "", ""), (2, "nothing", "", ""), (3, "zeta zt_0000", "", "")], "content_id long, content string, file_path string, key string")
    own = (rules.Rule("acme_key", r"\bacme-[0-9]{8}\b", hint="acme-"),)
    part = (rules.Part("Zeta", ("zeta",), r"\bzt_[0-9]{4}\b"),)
    got = {(x["content_id"], x["detector_name"]) for x in det.detect(rows, more=own, library=part).collect()}
    assert got == {(1, "acme_key"), (3, "zeta")}
    without_hint = (rules.Rule("any_key", r"\bacme-[0-9]{8}\b"),)
    assert {x["detector_name"] for x in det.detect(rows, only={"any_key"}, more=without_hint).collect()} == {"any_key"}


def test_few_texts_pass_the_gate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = docs.where("not text rlike '(?i)secret|token|passw|api|key|credential|auth|http|private'")
    empty = F.lit("")
    passed = plain.where(det.gate(F.col("text").cast("binary"), empty, empty)).count()
    assert passed < 0.05 * plain.count()
    one = docs.where(det.gate(F.col("text").cast("binary"), empty, empty, frozenset({"npm_token"}))).count()
    assert one <= docs.where("lower(text) like '%npm_%'").count()


def test_messages_of_a_hot_group(spark):
    rows = spark.range(1000).selectExpr("1 as id", "concat('m', id % 7) as m", "id as o").unionByName(spark.createDataFrame([(2, " ", 1)], "id int, m string, o long"))
    got = {x["id"]: x["messages"] for x in jobs.fnd.first_messages(rows, ["id"], F.col("m"), F.col("o")).collect()}
    assert got == {1: "m0; m1; m2"} and state.STATUSES
