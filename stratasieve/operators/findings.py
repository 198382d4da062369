"""Matches to findings: classify, redact, locate; then order, deduplicate and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import policy, scalar

PUBLIC = ["detector_name", "confidence", "disposition", "disposition_reason", "source_type", "manifest_digest", "platform", "file_path", "layer_digest", "key", "line_number", "redacted_value", "fingerprint", "context_snippet", "present_in_final_image"]
DETAIL = [*PUBLIC, "value", "raw_snippet", "source_location", "match_start", "match_end"]
#: order of findings, and of detailed findings
ORDER = ["manifest_digest", "platform", "source_type", "disposition", "file_path", "layer_digest", "detector_name", "line_number", "fingerprint", "key"]
DETAIL_ORDER = [*ORDER, "match_start", "match_end", "source_location"]


def normalise(matches: DataFrame) -> DataFrame:
    """Findings with their raw fields (DETAIL) from matches as `detect` gives them."""
    text = F.col("value").cast("string")
    m = matches.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in matches.columns else F.lit("") for c in ("manifest_digest", "platform", "file_path", "layer_digest", "key")})
    reason = policy.example_reason(F.col("file_path"), F.col("key"), F.col("line"), text)
    m = m.withColumns(
        {
            "disposition_reason": reason,
            "redacted_value": scalar.redact(text),
            "fingerprint": scalar.fingerprint(F.col("value")),
            "source_location": scalar.source_location(F.col("source_type"), F.col("file_path"), F.col("key")),
            "present_in_final_image": F.coalesce(F.col("present_in_final_image"), F.lit(False)) if "present_in_final_image" in matches.columns else F.lit(False),
        }
    )
    m = m.withColumn("disposition", F.when(F.col("disposition_reason") == "", "actionable").otherwise("example"))
    return m.withColumn("value", text).select(*DETAIL)


def _first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key. Of each key and task only its first row is shuffled."""
    names = [f"`first by {i}`" for i in range(len(keys))]
    out = df.select(*[k.alias(n.strip("`")) for k, n in zip(keys, names)], F.struct(*order, *[c for c in df.columns if c not in order]).alias("row"))
    return out.groupBy(*names).agg(F.min("row").alias("row")).select("row.*").select(*df.columns)


def dedup_public(findings: DataFrame) -> DataFrame:
    """One finding for each manifest, disposition, source location, line and context (else fingerprint)."""
    place = scalar.source_location(F.col("source_type"), F.col("file_path"), F.col("key"))
    return _first(findings, [F.col("manifest_digest"), F.col("disposition"), place, F.col("line_number"), scalar.first_non_blank(F.col("context_snippet"), F.col("fingerprint"))], ORDER)


def dedup_detailed(findings: DataFrame) -> DataFrame:
    """One finding for each manifest, disposition, source location, line, span and raw snippet (else context, else fingerprint)."""
    what = scalar.first_non_blank(F.col("raw_snippet"), F.col("context_snippet"), F.col("fingerprint"))
    return _first(findings, [F.col(c) for c in ("manifest_digest", "disposition", "source_location", "line_number", "match_start", "match_end")] + [what], DETAIL_ORDER)


def public(findings: DataFrame) -> DataFrame:
    """Without the raw fields."""
    return findings.select(*PUBLIC)


def persisted(findings: DataFrame, raw: bool = False) -> DataFrame:
    """Raw values and snippets are blank unless asked for."""
    return findings if raw else findings.withColumns({"value": F.lit(""), "raw_snippet": F.lit("")})


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actionable findings, and those of examples (suppressed)."""
    return findings.where("disposition = 'actionable'"), findings.where("disposition = 'example'")


def unique_fingerprints(findings: DataFrame) -> Column:
    """Aggregate: distinct fingerprints that aren't blank."""
    return F.count_distinct(F.when(~scalar.blank(F.col("fingerprint")), F.col("fingerprint")))


CAP = 3
CAP_KEY = ["detector_name", "confidence", "disposition", "source_type", "manifest_digest", "platform", "file_path", "layer_digest", "key", "line_number", "fingerprint", "present_in_final_image"]


def cap_low_confidence(findings: DataFrame, order: list[str] | None = None, cap: int = CAP) -> DataFrame:
    """Of low-confidence findings in files, the first `cap` of each group; its first row carries the group's size (occurrence_count) and what was left out (suppressed_occurrence_count)."""
    limited = (F.col("confidence") == "low") & (F.col("file_path") != "")
    order = order or [c for c in DETAIL_ORDER if c in findings.columns]
    low = findings.where(limited)
    # the row number alone: each task keeps `cap` rows of a group before the shuffle; sizes are counts
    low_first = low.withColumn("rank in group", F.row_number().over(W.partitionBy(*CAP_KEY).orderBy(*order))).where(F.col("rank in group") <= cap)
    sizes = low.groupBy(*[F.col(c).alias(f"group {c}") for c in CAP_KEY]).agg(F.count("*").alias("size of group"))
    first = F.col("rank in group") == 1
    same = [F.col(c).eqNullSafe(F.col(f"`group {c}`")) for c in CAP_KEY]
    low = low_first.join(sizes, same)
    low = low.withColumn("occurrence_count", F.when(first, F.col("size of group")).otherwise(0)).withColumn("suppressed_occurrence_count", F.when(first, F.greatest(F.col("size of group") - cap, F.lit(0))).otherwise(0)).select(*findings.columns, "occurrence_count", "suppressed_occurrence_count")
    zero = F.lit(0).cast("long")
    return findings.where(~limited).withColumns({"occurrence_count": zero, "suppressed_occurrence_count": zero}).unionByName(low)


def first_messages(rows: DataFrame, keys: list[str], message: Column, order: Column, n: int = 3) -> DataFrame:
    """keys and messages: the first n distinct messages of each key, joined. A message is first aggregated to its least order, so that no list is longer than n."""
    one = rows.where(~scalar.blank(message)).groupBy(*keys, message.alias("message")).agg(F.min(order).alias("o"))
    top = one.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("o", "message"))).where(F.col("k") <= n)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "message"))), lambda x: x["message"]), "; ").alias("messages"))
