"""Inputs of the catalogue's queries: rows built from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spark's spelling of the few functions that differ."""

    text = "string"

    def h(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def b64(self, x: str) -> str:
        return f"base64(cast({x} as binary))"

    def list(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def day(self, n: str) -> str:
        return f"(timestamp '2024-01-01 00:00:00' + make_dt_interval(cast({n} as int)))"


class Duck:
    text = "varchar"

    def h(self, x: str) -> str:
        return f"sha256({x})"

    def b64(self, x: str) -> str:
        return f"to_base64(encode({x}))"

    def list(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def day(self, n: str) -> str:
        return f"(timestamp '2024-01-01 00:00:00' + to_days(({n})::int))"


SPARK, DUCK = Spark(), Duck()
Template = Callable[[Spark | Duck], str]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(spark: SparkSession, sf_dir: str, template: Template) -> DataFrame:
    """The template's rows on Spark."""
    sql = template(SPARK)
    sql = sql.replace("{", "{{").replace("}", "}}")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used) if used else spark.sql(sql)


K = "c_custkey"
HEX = lambda d, salt, a, n: f"substr({d.h(f"'{salt}' || c_custkey")}, {a}, {n})"

#: rule: (token, text before, text after, path, key, check in SQL). Every seventh customer has a token cut short.
TOKENS: dict[str, tuple] = {
    "pem_private_key": (lambda d: f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {HEX(d, 'p', 1, 60)} || chr(10) || '-----END RSA PRIVATE KEY-----'", "key" + "é ", "", "", "", ""),
    "github_token": (lambda d: f"'ghp_' || {HEX(d, 'g', 1, 36)}", "export é T=", " # end", "app/.env", "", ""),
    "gitlab_token": (lambda d: f"'glpat-' || {HEX(d, 'l', 1, 20)}", "use ", " now", "", "", ""),
    "slack_token": (lambda d: f"'xoxb-' || lpad('' || c_custkey, 11, '1') || '-' || lpad('' || c_custkey, 12, '2') || '-' || {HEX(d, 's', 1, 20)}", "é: ", "", "etc/app.yaml", "", ""),
    "slack_webhook": (lambda d: f"'https://hooks.slack.com/services/T' || upper({HEX(d, 'w', 1, 9)}) || '/B' || upper({HEX(d, 'w', 11, 9)}) || '/' || {HEX(d, 'w', 21, 24)}", "hook ", " x", "", "", ""),
    "stripe_key": (lambda d: f"'sk_live_' || {HEX(d, 't', 1, 24)}", "k ", "", "", "STRIPE_SECRET", ""),
    "aws_access_key_id": (lambda d: f"'AKIA' || upper({HEX(d, 'a', 1, 16)})", "id ", ";", "home/.docker/x", "", ""),
    "google_api_key": (lambda d: f"'AIza' || {HEX(d, 'o', 1, 35)}", "maps=", " ", "", "", ""),
    "sendgrid_api_key": (lambda d: f"'SG.' || {HEX(d, 'n', 1, 22)} || '.' || {HEX(d, 'm', 1, 43)}", "mail ", "", "", "", ""),
    "shopify_access_token": (lambda d: f"'shpat_' || {HEX(d, 'y', 1, 32)}", "shop ", "", "", "", ""),
    "npm_token": (lambda d: f"'npm_' || {HEX(d, 'q', 1, 36)}", "npm ", "", "", "", ""),
    "aws_secret_access_key": (lambda d: f"upper({HEX(d, 'x', 1, 20)}) || {HEX(d, 'x', 21, 20)}", "AWS_SECRET_ACCESS_KEY = ", "", "", "", "regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')"),
    "npmrc_auth_token": (lambda d: f"'tok' || {HEX(d, 'z', 1, 20)}", "//registry.npmjs.org/:_authToken=", "", "root/.npmrc", "", "strlen(v) >= 8"),
    "npmrc_auth": (lambda d: d.b64(f"'user' || c_custkey || ':' || {HEX(d, 'e', 1, 8)}"), "_auth=", "", "root/.npmrc", "", "c_custkey % 7 <> 0"),
    "docker_auth_blob": (lambda d: d.b64(f"'user' || c_custkey || ':' || {HEX(d, 'd', 1, 8)}"), '{"auths":{"r.io":{"auth":"', '"}}}', "", "", "c_custkey % 7 <> 0"),
    "docker_config_identitytoken": (lambda d: f"{HEX(d, 'i', 1, 20)} || upper({HEX(d, 'i', 21, 20)})", '{"identitytoken":"', '"}', "root/.docker/config.json", "", "strlen(v) >= 16 and list_entropy(string_split(v, '')) >= 3.75"),
    "terraform_cloud_token": (lambda d: f"{HEX(d, 'r', 1, 14)} || '.atlasv1.' || {HEX(d, 'r', 15, 40)}", 'token = "', '"', "root/.terraformrc", "", "strlen(v) >= 16 and list_entropy(string_split(v, '')) >= 3.75"),
    "jwt": (lambda d: f"case when c_custkey % 5 = 1 then 'eyJhbGci' || {HEX(d, 'j', 1, 20)} else 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9' end || '.' || {HEX(d, 'j', 21, 30)} || '.' || {HEX(d, 'u', 1, 30)}", "bearer ", "", "", "", "c_custkey % 5 <> 1"),
    "netrc_password": (lambda d: HEX(d, "v", 1, 12), "machine h login u password ", "", "root/.netrc", "", "strlen(v) >= 4"),
    "pypirc_password": (lambda d: HEX(d, "b", 1, 16), "password = ", "", "root/.pypirc", "", "strlen(v) >= 4"),
    "basic_auth_url": (lambda d: f"'https://user' || c_custkey || ':' || {HEX(d, 'c', 1, 10)} || '@host' || c_custkey || '.internal.io'", "see ", "/path x", "", "", "c_custkey % 7 <> 0"),
}
#: rules whose cut token would still match keep it whole
WHOLE = {"netrc_password", "pypirc_password"}


def token_rows(rule: str) -> Template:
    token, before, after, path, key, _ = TOKENS[rule]

    def sql(d: Spark | Duck) -> str:
        t = token(d)
        cut = t if rule in WHOLE else f"case when c_custkey % 7 = 0 then substr({t}, 1, 6) else {t} end"
        q = lambda x: x.replace("'", "''")
        return f"select c_custkey as content_id, 'é first line ' || c_custkey || chr(10) || '{q(before)}' || {cut} || '{q(after)}' as content, '{path}' as file_path, '{key}' as key, c_custkey from customer"

    return sql


#: what stands before, around and after candidates: the assigned-prefix matrix
SHAPES = ("password=", 'password="', "token: ", 'token = "', "api_key => ", "secret ", "auth:=", "name: ")


def candidate_rows(d: Spark | Duck) -> str:
    arms = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SHAPES))
    value = f"case when c_custkey % 3 = 0 then repeat('ab1', 8) else 'Zq9' || {HEX(d, 'en', 1, 30)} end"
    return f"select c_custkey as content_id, 'plain line' || chr(10) || 'my ' || case cast(c_custkey % {len(SHAPES)} as int) {arms} end || {value} as content, case when c_custkey % 5 = 0 then 'conf/app.key' else 'app/x.txt' end as file_path, '' as key from customer"


def finding_rows(d: Spark | Duck) -> str:
    """Findings with many equal keys."""
    v = "'v' || (l_partkey % 40)"
    return f"""select 'sha256:m' || (l_orderkey % 5) as manifest_digest, case when l_orderkey % 2 = 0 then 'linux/amd64' else 'linux/arm64/v8' end as platform,
  case when l_suppkey % 3 = 0 then 'env' else 'file_final' end as source_type, case when l_partkey % 4 = 0 then 'example' else 'actionable' end as disposition, case when l_partkey % 4 = 0 then 'test_path' else '' end as disposition_reason,
  case when l_suppkey % 3 = 0 then '' else 'app/f' || (l_partkey % 7) end as file_path, 'sha256:l' || (l_linenumber % 3) as layer_digest, case when l_linenumber % 2 = 0 then 'github_token' else 'keyword_entropy' end as detector_name,
  case when l_linenumber % 2 = 0 then 'high' else 'low' end as confidence, cast(l_partkey % 9 + 1 as int) as line_number, {d.h(v)} as fingerprint, case when l_suppkey % 3 = 0 then 'KEY' else '' end as key, '***' || (l_partkey % 40) as redacted_value,
  case when l_partkey % 11 = 0 then ' ' else 'ctx ' || (l_partkey % 20) end as context_snippet, l_suppkey % 2 = 0 as present_in_final_image, {v} as value, case when l_partkey % 3 = 0 then '' else 'raw ' || (l_partkey % 20) end as raw_snippet,
  case when l_suppkey % 3 = 0 then 'env:KEY' else 'file_final:app/f' || (l_partkey % 7) end as source_location, cast(l_partkey % 6 as bigint) as match_start, cast(l_partkey % 6 + 4 as bigint) as match_end from lineitem"""


def config_rows(d: Spark | Duck) -> str:
    """Image configurations as JSON."""
    c = "c_custkey"
    body = f"""'{{"architecture":"amd64","os":"linux","author":"' || case when {c} % 3 = 0 then '  ' else 'a' || {c} end || '","config":{{"Hostname":"h' || {c} || '","User":" root ","WorkingDir":"/srv","Env":["PATH=/bin","TOKEN=' || substr({d.h(c + " || ''")}, 1, 12) || '","ALONE"],"Cmd":["run","--id=' || {c} || '"],"Labels":{{"z":"1","a":"v' || {c} || '"}},"ExposedPorts":{{"80/tcp":{{}},"443/tcp":{{}}}}}},"history":[{{"created_by":"ADD ' || {c} || '","comment":""}},{{"created_by":" ","author":"me","comment":"note"}}]}}'"""
    return f"select {c} as id, {body} as body from customer"


def replay_rows(d: Spark | Duck) -> str:
    """Layer events: image by order, layer by line, two entries a layer."""
    return """select 'm' || (l_orderkey % 200) as manifest_digest, cast(l_orderkey % 200 as int) as img, cast(floor(l_orderkey / 200.0) % 6 as int) as layer_idx, cast(row_number() over (partition by l_orderkey % 200, cast(floor(l_orderkey / 200.0) % 6 as int) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as int) as entry_idx,
  case when l_partkey % 13 = 0 then 'opaque' when l_partkey % 7 = 0 then 'whiteout' else 'put' end as op, case when l_partkey % 3 = 0 then 'etc/d' || (l_suppkey % 3) else 'app/d' || (l_suppkey % 3) end as dir, 'f' || (l_partkey % 5) as name, case when l_partkey % 17 = 0 then 'symlink' else 'regular' end as kind from lineitem"""


def state_rows(table: str, part: str) -> Template:
    """What a state table holds (`old`) and what comes in (`new`), from customers and orders."""

    def sql(d: Spark | Duck) -> str:
        keep = "c_custkey % 3 <> 0" if part == "old" else "c_custkey % 3 <> 1"
        at = d.day("0") if part == "old" else d.day("10")
        seen = f", {at} as first_seen_at, {at} as last_seen_at" if part == "old" else ""
        reg = "case when c_custkey % 2 = 0 then 'docker.io' else 'ghcr.io' end"
        plat = f"case when {1 if part == 'new' else 0} = 1 and c_custkey % 4 = 0 then '' else 'linux' end as platform_os, case when c_custkey % 2 = 0 then 'amd64' else 'arm64' end as platform_architecture, '' as platform_variant"
        stat = f"case when c_custkey % 5 = {0 if part == 'old' else 1} then 'failed' else 'scanned' end as last_scan_status, case when c_custkey % 5 = {0 if part == 'old' else 1} then 'e' || c_custkey else '' end as last_scan_error"
        body = {
            "repositories": f"select {'c_custkey as id, ' if part == 'old' else ''}{reg} as registry, 'r' || c_custkey as repository{seen}",
            "manifests": f"select 'sha256:' || c_custkey as digest, {plat}{seen}, {stat}",
            "repository_manifests": f"select cast(c_custkey % 50 as bigint) as repository_id, 'sha256:' || c_custkey as manifest_digest, '{part}' || c_custkey as root_digest{seen}, {stat}",
            "tags": f"select cast(c_custkey % 50 as bigint) as repository_id, 't' || (c_custkey % 20) as tag, 'sha256:{part}' || c_custkey as manifest_digest, 'root' as root_digest, 'linux' as platform_os, 'amd64' as platform_architecture, '' as platform_variant, 'resolved' as status, '' as error{seen}",
            "findings": f"select {'c_custkey as id, ' if part == 'old' else ''}'sha256:' || (c_custkey % 100) as manifest_digest, {d.h(K + " || ''")} as fingerprint, '{part}***' as redacted_value, {'c_name' if part == 'old' else "case when c_custkey % 2 = 0 then '' else c_name end"} as value{seen}",
            "finding_occurrences": f"select {'c_custkey as id, ' if part == 'old' else ''}c_custkey as finding_id, 'github_token' as detector_name, 'high' as confidence, 'env' as source_type, 'linux' as platform_os, 'amd64' as platform_architecture, '' as platform_variant, '' as file_path, '' as layer_digest, 'K' || c_custkey as source_key, 'ctx' as context_snippet, '' as raw_snippet, 'env:K' || c_custkey as source_location, cast(c_custkey % 7 as int) as match_start, cast(c_custkey % 7 + 40 as int) as match_end, c_custkey % 2 = 0 as present_in_final_image{seen}, '{'actionable' if part == 'old' else 'example'}' as disposition, '{'' if part == 'old' else 'test_path'}' as disposition_reason, cast({1 if part == 'old' else 2} as int) as line_number",
        }[table]
        return f"{body} from customer where {keep}"

    return sql


def run_rows(d: Spark | Duck) -> str:
    """scan_runs, one per order."""
    n = lambda x, name: f"cast({x} as int) as {name}"
    return f"""select o_orderkey as id, cast(o_custkey % 50 as bigint) as repository_id, 'img:' || o_orderkey as requested_reference, 'docker.io/library/img:' || o_orderkey as resolved_reference, '' as requested_digest, 'reference' as mode,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'partial' else 'failed' end as status, '' as error_message, {n('o_orderkey % 4', 'tags_enumerated')}, {n('o_orderkey % 3', 'tags_resolved')}, {n('o_orderkey % 2', 'tags_failed')}, {n(1, 'target_count')}, {n(1, 'completed_target_count')}, {n(0, 'failed_target_count')}, {n('o_orderkey % 3', 'manifest_count')}, {n('o_orderkey % 3', 'completed_manifest_count')}, {n(0, 'failed_manifest_count')}, {n('o_orderkey % 9', 'total_findings')}, {n('o_orderkey % 5', 'unique_fingerprints')}, {n('o_orderkey % 2', 'suppressed_findings_count')}, {n(0, 'suppressed_unique_fingerprints')}, '{{"n":' || o_orderkey || '}}' as result_json, {d.day('o_orderkey % 700')} as scanned_at from orders"""


def repo_rows(d: Spark | Duck) -> str:
    return f"select cast(n_nationkey * 2 as bigint) as id, 'docker.io' as registry, 'library/' || lower(n_name) as repository, {d.day('n_nationkey')} as first_seen_at, {d.day('n_nationkey * 3 % 11')} as last_seen_at from nation union all select cast(n_nationkey * 2 + 1 as bigint), 'ghcr.io', 'org/' || lower(n_name), {d.day('1')}, {d.day('n_nationkey % 4')} from nation"


def repo_manifest_rows(d: Spark | Duck) -> str:
    return f"select cast(p_partkey % 50 as bigint) as repository_id, 'sha256:' || p_partkey as manifest_digest, 'root' as root_digest, {d.day('0')} as first_seen_at, {d.day('1')} as last_seen_at, 'scanned' as last_scan_status, '' as last_scan_error from part"


def stored_finding_rows(d: Spark | Duck) -> str:
    return f"select o_orderkey as id, 'sha256:' || (o_custkey % 200 + 1) as manifest_digest, {d.h("'f' || o_orderkey")} as fingerprint, '***' || (o_orderkey % 10) as redacted_value, 'secret' as value, {d.day('o_orderkey % 5')} as first_seen_at, {d.day('o_orderkey % 300')} as last_seen_at from orders"


def stored_occurrence_rows(d: Spark | Duck) -> str:
    return f"""select l_orderkey * 10 + l_linenumber as id, l_orderkey as finding_id, case when l_linenumber % 2 = 0 then 'jwt' else 'github_token' end as detector_name, 'high' as confidence, 'env' as source_type, 'linux' as platform_os, 'amd64' as platform_architecture, '' as platform_variant, '' as file_path, '' as layer_digest, 'K' as source_key, 'c' as context_snippet, '' as raw_snippet, 'env:K' || l_linenumber as source_location, 0 as match_start, 4 as match_end, true as present_in_final_image, {d.day('0')} as first_seen_at, {d.day('l_linenumber % 3')} as last_seen_at, case when l_partkey % 3 = 0 then 'example' else 'actionable' end as disposition, '' as disposition_reason, 1 as line_number from lineitem"""
