"""Rule-based analyst advisories as one array-of-struct Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (id prefix, action type, summary, guidance, default missing evidence)
RATE_LIMIT = (
    "RATE_LIMIT", "Rate Limiting Review",
    "Review application rate limiting and connection pool thresholds.",
    "Inspect ingress reverse proxy and firewall connection metrics to identify unusually dense connection "
    "clusters. Verify that connection timeout thresholds and keep-alive limits protect service availability "
    "without dropping legitimate traffic.",
    ["Upstream link saturation telemetries"],
)
INVESTIGATE_AUTH = (
    "INVESTIGATE_AUTH", "Investigation",
    "Correlate repetitive connection attempts with authentication daemon audit logs.",
    "Examine host authentication logs (e.g. sshd auth.log, web access logs) to evaluate whether credential "
    "spraying or password dictionary attempts occurred, and verify that multi-factor authentication or "
    "account lockouts were successfully enforced.",
    ["Authentication failure logs"],
)
INVESTIGATE_C2 = (
    "INVESTIGATE_C2", "Investigation",
    "Investigate internal endpoints exhibiting periodic outbound beaconing.",
    "Perform host forensic triage on systems initiating recurring communication intervals. Inspect DNS query "
    "logs, active socket states, and scheduled tasks to verify if unauthorized background processes or "
    "malware implants are active.",
    ["Process execution telemetry", "DNS logs"],
)
ENRICH_PAYLOAD = (
    "ENRICH_PAYLOAD", "Telemetry Enrichment",
    "Correlate network flow anomalies with application and host security telemetries.",
    "Flow statistics suggest potential exploitation activity, but Netflow lacks payload inspection. "
    "Cross-reference events against Web Application Firewall (WAF) logs, database error logs, and endpoint "
    "detection alerts before concluding a breach attempt occurred.",
    ["WAF transaction logs", "Payload captures"],
)
ENRICH_ASSET = (
    "ENRICH_ASSET", "Telemetry Enrichment",
    "Query enterprise asset inventory (CMDB) to resolve missing target impact.",
    "The operational risk band was withheld because destination asset criticality telemetry is missing from "
    "flow records. Link the observed destination port and network segment to an authoritative asset "
    "management database to calculate a verified complete TLRS.",
    ["Destination host asset criticality", "Device role classification"],
)
VERIFY_ML = (
    "VERIFY_ML", "Investigation",
    "Classifier validation reliability is low; verify flow characteristics manually.",
    "Analysts must manually inspect flow duration, packet rates, and protocol flags rather than relying on "
    "automated ML prediction labels.",
    ["Independent packet trace capture", "Validation ground truth confirmation"],
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def priority_sql(scoring_status: str, band: str, provisional: str) -> str:
    """Band of a complete score, else the provisional band, else Medium; Informational is shown as Low."""
    chosen = (f"CASE WHEN {scoring_status} = 'complete' THEN {band} "
              f"WHEN {provisional} <> '' THEN trim(element_at(split({provisional}, ':'), -1)) ELSE 'Medium' END")
    return f"replace({chosen}, 'Informational', 'Low')"


def recommendation_id_sql(prefix: str, category: str) -> str:
    clean = f"upper(translate({category}, ' -', '__'))"
    return f"concat_ws('-', 'REC', {prefix}, {clean}, substring(sha2(concat_ws(':', {prefix}, {clean}), 256), 1, 6))"


def advisory_priority(scoring_status: str, band: str, provisional: str) -> Column:
    return F.expr(priority_sql(scoring_status, band, provisional))


def recommendation_id(prefix: str, category_col: str) -> Column:
    return F.expr(recommendation_id_sql(_text(prefix), category_col))


def _advisory(rule, category: str, priority: str, guidance: str | None = None, evidence: str | None = None) -> str:
    prefix, action, summary, text, missing = rule
    default = "array(" + ", ".join(_text(m) for m in missing) + ")"
    return f"""named_struct(
        'recommendation_id', {recommendation_id_sql(_text(prefix), category)},
        'threat_category', {category},
        'priority', {priority},
        'action_type', {_text(action)},
        'summary', {_text(summary)},
        'detailed_guidance', {guidance or _text(text)},
        'missing_evidence_required', {f'coalesce({evidence}, {default})' if evidence else default},
        'analyst_validation_required', true)"""


def advisories(
    category: str, scoring_status: str, band: str, provisional: str, missing_telemetry: str,
    reliability_status: str, reliability_rationale: str,
) -> Column:
    """Category rule first, then the missing-asset and the weak-classifier advisories.

    The arguments are column names.
    """
    priority = priority_sql(scoring_status, band, provisional)

    def by_category(rule) -> str:
        return _advisory(rule, category, priority, evidence=missing_telemetry)

    category_rule = f"""CASE WHEN contains({category}, 'DoS') THEN {by_category(RATE_LIMIT)}
        WHEN contains({category}, 'Brute') THEN {by_category(INVESTIGATE_AUTH)}
        WHEN {category} = 'Bot' THEN {by_category(INVESTIGATE_C2)}
        WHEN {category} IN ('Infiltration', 'SQL Injection') THEN {by_category(ENRICH_PAYLOAD)} END"""
    asset_rule = (f"CASE WHEN {scoring_status} = 'insufficient_evidence' "
                  f"THEN {_advisory(ENRICH_ASSET, category, _text('Medium'))} END")
    reliability_text = (
        f"concat({_text('The ML classifier' + chr(39) + 's validation reliability for ' + chr(39))}, {category}, "
        f"{_text(chr(39) + ' is ' + chr(39))}, {reliability_status}, {_text(chr(39) + ' (')}, {reliability_rationale}, "
        f"'). ', {_text(VERIFY_ML[3])})")
    reliability_rule = (f"CASE WHEN {reliability_status} IN ('UNRELIABLE', 'NON_EVALUABLE') "
                        f"THEN {_advisory(VERIFY_ML, category, _text('Medium'), guidance=reliability_text)} END")
    return F.expr(f"filter(array({category_rule}, {asset_rule}, {reliability_rule}), a -> a IS NOT NULL)")
