"""python -m stratasieve scan REFERENCE [--platform os/architecture] [--format summary|json].

Settings come from the environment (sources.config). Exit code 0: nothing found; 1: an error, or a limit was met; 2: findings.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import references as ref
from .plans import jobs
from .sources import config
from .sources.store import NoStore, Store, findings_file_name, write_findings_file


def report(run: jobs.Run, form: str, path: str) -> str:
    if form == "json":
        findings = [json.loads(x["json"]) for x in run.scan.findings.select(F.to_json(F.struct("detector_name", "confidence", "disposition", "disposition_reason", "source_type", "manifest_digest", "platform", "file_path", "layer_digest", "key", "line_number", "redacted_value", "fingerprint", "context_snippet", "present_in_final_image")).alias("json")).toLocalIterator()]
        return json.dumps(run.result() | {"findings": findings}, indent=2)
    lines = [f"{k}: {v}" for k, v in run.result().items() if v != ""]
    lines += [f"{x['platform'] or 'unknown'} {x['manifest_digest']} {x['status']} {x['actionable']} found, {x['suppressed']} suppressed {x['error']}".rstrip() for x in run.scan.summary().toLocalIterator()]
    return "\n".join([*lines, f"findings: {path}"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratasieve")
    scan = parser.add_subparsers(dest="command", required=True).add_parser("scan", help="scan an image reference, or all tags of a repository")
    scan.add_argument("reference")
    scan.add_argument("--platform", default="")
    scan.add_argument("--format", choices=("summary", "json"), default="summary")
    args = parser.parse_args(argv)
    try:
        settings = config.load(os.environ if environment is None else environment)
        ref.parse(args.reference), ref.parse_platform(args.platform)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("stratasieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    at = F.lit(spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).first()[0]).cast("timestamp")
    store = Store(spark, settings.state_dir) if settings.state_dir else NoStore()
    with tempfile.TemporaryDirectory(prefix="stratasieve-") as own:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder and not spark.sparkContext.master.startswith("local"):
            print("spark.checkpoint.dir must name a folder that the driver and all executors share", file=sys.stderr)
            return 1
        run = jobs.scan_and_save(spark, args.reference, store, f"{folder or own}/{os.path.basename(own)}", at, settings, args.platform)
        name = spark.range(1).select(findings_file_name(at, F.lit(run.resolved_reference))).first()[0]
        path = write_findings_file(run.scan.findings, settings.findings_dir, name, settings.persist_raw)
        print(report(run, args.format, path))
        if run.error:
            print(run.error, file=sys.stderr)
        return run.exit_code()


if __name__ == "__main__":
    sys.exit(main())
