"""Common table expressions of the SQL counterparts, assembled by name."""

from __future__ import annotations

from flowintel import dims
from flowintel.sources import flowview


def values(rows) -> str:
    """SQL VALUES list."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(lit(x) for x in v) + "]::VARCHAR[]"
        return str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def finite(col: str) -> str:
    v = f"TRY_CAST({col} AS DOUBLE)"
    return (f"CASE WHEN {col} IS NULL OR {col}='' OR isnan({v}) OR isinf({v}) THEN 0.0::DOUBLE ELSE {v} END")


def _typed_column(name: str) -> str:
    if name in dims.RATE_COLUMNS:
        return finite(f"r.{name}")
    if name == dims.RATIO_COLUMN:
        return f"CASE WHEN TRY_CAST(r.tot_fwd_pkts AS DOUBLE)=0 THEN 0.0::DOUBLE ELSE {finite('r.' + name)} END"
    if name in dims.INT_COLUMNS:
        return f"TRY_CAST(r.{name} AS INTEGER)"
    if name == "label":
        return "coalesce(lm.canonical_label, r.label)"
    if name in dims.RAW_BY_SNAKE and name != "timestamp":
        return f"TRY_CAST(r.{name} AS DOUBLE)"
    return f'r."{name}"'


FLOW_COLUMNS = list(flowview.EXPRESSIONS)
_PARSED = "try_strptime(r.\"timestamp\",'%d/%m/%Y %H:%M:%S')"
_MONTHS = dims.CAMPAIGN_DATES

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, list(needs))


def with_ctes(body: str, *needs: str) -> str:
    """`body` preceded by the named expressions and everything they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body


cte("label_map", "SELECT * FROM (VALUES " + values(dims.LABEL_MAPPING.items()) + ") t(raw_label, canonical_label)")
cte("classes", "SELECT * FROM (VALUES " + values((i, c) for c, i in dims.CLASS_INDEX.items())
    + ") t(class_index, class_name)")
cte("keyed", "SELECT " + ", ".join(flowview.KEY_COLUMNS) + ", "
    + ", ".join(f"{e} AS {n}" for n, e in flowview.DERIVED.items()) + " FROM lineitem")
cte("days", f"SELECT *, {flowview.DAY} AS day_s FROM keyed", "keyed")
cte("raw", "SELECT " + ", ".join(f'{e.format(s="varchar")} AS "{n}"' for n, e in flowview.EXPRESSIONS.items())
    + ", l_orderkey, l_partkey, l_suppkey, l_linenumber FROM days", "days")
cte("typed", "SELECT " + ", ".join(f'{_typed_column(n)} AS "{n}"' for n in FLOW_COLUMNS)
    + f", r.label AS raw_label, {_PARSED} AS timestamp_parsed, CAST({_PARSED} AS DATE) AS event_date,"
    " r.l_orderkey, r.l_partkey, r.l_suppkey, r.l_linenumber"
    " FROM raw r LEFT JOIN label_map lm ON r.label=lm.raw_label WHERE r.label<>'Label'", "raw", "label_map")
cte("clean", "SELECT * FROM typed WHERE flow_duration>=0 AND event_date IS NOT NULL", "typed")

cte("port_counts", "SELECT label AS class_name, dst_port AS port, count(*) AS flow_count FROM clean GROUP BY 1,2", "clean")
cte("services", "SELECT * FROM (VALUES " + values(dims.PORT_SERVICES.items()) + ") t(port, known_service)")
cte("criticality", "SELECT * FROM (VALUES " + values(dims.PORT_CRITICALITY.items()) + ") t(port, known_criticality)")
cte("ranked_ports", """SELECT *, CAST(sum(flow_count) OVER (PARTITION BY class_name) AS BIGINT) AS total_flows,
 CAST(row_number() OVER (PARTITION BY class_name ORDER BY flow_count DESC, port) AS INTEGER) AS rank FROM port_counts""",
    "port_counts")
cte("top_ports", """SELECT class_name, rank, r.port AS port,
 coalesce(known_service, 'Custom / Unassigned (' || r.port || ')') AS service_name,
 CAST(coalesce(known_criticality, 50) AS INTEGER) AS criticality_weight, flow_count, total_flows,
 round(flow_count::DOUBLE/total_flows*100, 2) AS percentage_within_class
 FROM ranked_ports r LEFT JOIN services s ON r.port=s.port LEFT JOIN criticality c ON r.port=c.port WHERE rank<=5""",
    "ranked_ports", "services", "criticality")
cte("concentration", """SELECT class_name, total_flows,
 round(max(percentage_within_class) FILTER (WHERE rank=1), 2) AS concentration_top_1_port_pct,
 round(sum(percentage_within_class) FILTER (WHERE rank<=3), 2) AS concentration_top_3_ports_pct
 FROM top_ports GROUP BY 1,2""", "top_ports")

cte("label_dates", "SELECT label AS class_name, event_date, count(*) AS flow_count FROM clean GROUP BY 1,2", "clean")
cte("temporal", """SELECT class_name, count(*) AS active_days_count,
 arg_max(event_date, flow_count*1000000-(event_date-DATE '1970-01-01')) AS primary_event_date,
 max(flow_count) AS primary_day_count, sum(flow_count) AS total FROM label_dates GROUP BY 1""", "label_dates")


def aggregates(window_start: str, window_end: str, unit: str, window_type: str) -> str:
    return f"""SELECT label, {window_start} AS window_start, {window_end} AS window_end, count(*) AS flow_count,
 CAST(floor(CAST(coalesce(sum(CAST(totlen_fwd_pkts+totlen_bwd_pkts AS DECIMAL(30,4))),0) AS DECIMAL(38,4))+0.5) AS BIGINT) AS total_bytes,
 CAST(floor(CAST(coalesce(sum(CAST(tot_fwd_pkts+tot_bwd_pkts AS DECIMAL(30,4))),0) AS DECIMAL(38,4))+0.5) AS BIGINT) AS total_packets,
 CAST(count(DISTINCT {unit}) AS INTEGER) AS active_observation_units,
 min(timestamp_parsed) AS first_seen_timestamp, max(timestamp_parsed) AS last_seen_timestamp,
 '{window_type}' AS window_type FROM clean GROUP BY 1,2,3"""


cte("campaign_aggregates", aggregates(
    "TIMESTAMP '2018-02-14 00:00:00'", "TIMESTAMP '2018-03-03 00:00:00'", "event_date", "full_campaign"), "clean")
cte("daily_aggregates", aggregates(
    "date_trunc('day', timestamp_parsed)", "date_trunc('day', timestamp_parsed) + INTERVAL 1 DAY",
    "hour(timestamp_parsed)", "daily"), "clean")
cte("hourly_aggregates", aggregates(
    "date_trunc('hour', timestamp_parsed)", "date_trunc('hour', timestamp_parsed) + INTERVAL 1 HOUR",
    "minute(timestamp_parsed)//5", "hourly"), "clean")

cte("category_lookup", "SELECT raw_label AS k, canonical_label AS canonical FROM label_map "
    "UNION SELECT class_name, class_name FROM classes", "label_map", "classes")
cte("severity", "SELECT * FROM (VALUES " + values(dims.SEVERITY_PRIORS.items()) + ") t(label, prior)")
cte("techniques", "SELECT * FROM (VALUES " + values(dims.TECHNIQUE_MAPPINGS)
    + ") t(label, technique_id, technique_name, tactic, mapping_status, rationale, missing_telemetry)")


def categorized(source: str) -> str:
    return f"""SELECT a.* EXCLUDE(label), coalesce(c.canonical,'UNKNOWN') AS canonical_label, trim(coalesce(a.label,'')) AS raw_label,
 CASE WHEN c.canonical IS NULL THEN 'UNKNOWN' WHEN c.canonical='Benign' THEN 'BENIGN' ELSE 'ATTACK' END AS attack_status,
 c.canonical<>'Benign' AS is_attack, c.canonical IS NOT NULL AS is_mapped
 FROM {source} a LEFT JOIN category_lookup c ON trim(coalesce(a.label,''))=c.k"""


BAND = ("CASE WHEN {x}<20 THEN 'Informational' WHEN {x}<40 THEN 'Low' WHEN {x}<60 THEN 'Medium' "
        "WHEN {x}<80 THEN 'High' ELSE 'Critical' END")
AVAILABLE = repr(dims.WEIGHT_SEVERITY + dims.WEIGHT_FREQUENCY + dims.WEIGHT_RECURRENCE) + "::DOUBLE"


def scored(source: str, impact: str = "NULL::DOUBLE") -> str:
    """Scores of the aggregates named `source`."""
    return f"""SELECT *, {BAND.format(x='tlrs_normalized_rounded')} AS provisional,
 {BAND.format(x='tlrs_complete_rounded')} AS complete_band FROM (
 SELECT *, partial/{AVAILABLE} AS normalized, CAST(floor(partial/{AVAILABLE}+0.5) AS INTEGER) AS tlrs_normalized_rounded,
 partial+impact*0.15::DOUBLE AS complete, CAST(floor(partial+impact*0.15::DOUBLE+0.5) AS INTEGER) AS tlrs_complete_rounded FROM (
 SELECT *, severity*0.4::DOUBLE + frequency*0.25::DOUBLE + recurrence*0.2::DOUBLE AS partial FROM (
 SELECT c.*, coalesce(s.prior, 50.0::DOUBLE) AS severity,
 CASE WHEN flow_count>0 THEN greatest(0.0, least(100.0, log10(flow_count::DOUBLE)/6.0::DOUBLE*100.0)) ELSE 0.0 END::DOUBLE AS frequency,
 CASE window_type WHEN 'daily' THEN 24 WHEN 'hourly' THEN 12 ELSE 8 END AS recurrence_denominator,
 CASE WHEN active_observation_units>0 THEN least(100.0::DOUBLE, active_observation_units::DOUBLE/
   (CASE window_type WHEN 'daily' THEN 24 WHEN 'hourly' THEN 12 ELSE 8 END)::DOUBLE*100.0) ELSE 0.0 END::DOUBLE AS recurrence,
 {impact} AS impact
 FROM ({categorized(source)}) c LEFT JOIN severity s ON c.canonical_label=s.label)))"""


for kind in ("campaign", "daily", "hourly"):
    cte(f"{kind}_scored", scored(f"{kind}_aggregates"), f"{kind}_aggregates", "category_lookup", "severity")

RUN_ID = "run_fixed"
MANIFEST = "0123456789abcdef"


def short_hash(*parts: str) -> str:
    return "substr(sha256(" + " || ':' || ".join(parts) + "),1,16)"


_START = "strftime(window_start,'%Y-%m-%dT%H:%M:%S')"
_END = "strftime(window_end,'%Y-%m-%dT%H:%M:%S')"
for kind in ("campaign", "daily", "hourly"):
    cte(f"{kind}_profiles", f"""SELECT *, {short_hash('profile_id', f"'{RUN_ID}'", f"'{MANIFEST}'", "'1.0'")} AS snapshot_id FROM (
 SELECT s.* REPLACE({_START} AS window_start, {_END} AS window_end),
 {short_hash("'curated_dataset_flows'", 'canonical_label', _START, _END, 'window_type')} AS profile_id,
 t.technique_id, t.technique_name, t.tactic, coalesce(t.mapping_status,'unverified') AS mapping_status,
 coalesce(t.rationale, '{dims.FALLBACK_RATIONALE}') AS rationale,
 coalesce(t.missing_telemetry, ['{dims.FALLBACK_TELEMETRY[0]}']) AS missing_telemetry
 FROM {kind}_scored s LEFT JOIN techniques t ON s.canonical_label=t.label)""", f"{kind}_scored", "techniques")

# deterministic pseudo-predictions
cte("indexed", "SELECT c.*, coalesce(k.class_index, -1)::DOUBLE AS label_idx FROM clean c LEFT JOIN classes k "
    "ON c.label=k.class_name", "clean", "classes")
_TRAIN = ",".join(f"'{d}'" for d in dims.INTER_DAY_TRAIN)
_VAL = ",".join(f"'{d}'" for d in dims.INTER_DAY_VAL)
cte("by_day", f"""SELECT *, CASE WHEN event_date::VARCHAR IN ({_TRAIN}) THEN 'train'
 WHEN event_date::VARCHAR IN ({_VAL}) THEN 'val' ELSE 'test' END AS split FROM indexed""", "indexed")
cte("predictions", """SELECT *, CASE WHEN (l_partkey*3+l_orderkey)%10<7 THEN label_idx
 ELSE ((label_idx::BIGINT+11)%14)::DOUBLE END AS prediction,
 ((l_orderkey*17+l_partkey)%1000)::DOUBLE/1000 AS score FROM by_day""", "by_day")
cte("adjusted", """SELECT *, CASE WHEN (prediction=11 AND score<0.6::DOUBLE) OR (prediction=2 AND score<0.35::DOUBLE)
 THEN 0.0::DOUBLE ELSE prediction END AS adjusted_prediction FROM predictions""", "predictions")


def cells(source: str, by: str = "", pred: str = "prediction", where: str = "true") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}label_idx::INTEGER AS true_idx, {pred}::INTEGER AS pred_idx, count(*) AS n FROM {source}
 WHERE {where} AND label_idx BETWEEN 0 AND 13 AND {pred} BETWEEN 0 AND 13 GROUP BY ALL"""


def support(source: str, by: str = "") -> str:
    """tp / true / predicted support per class of the cells named `source`, absent classes included."""
    lead = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {source}) g, classes k" if by else "classes k"
    same = "".join(f" AND x.{c.strip()}=g.{c.strip()}" for c in by.split(",")) if by else ""
    glead = "".join(f"g.{c.strip()}, " for c in by.split(",")) if by else ""
    return f"""SELECT {glead}k.class_index, k.class_name,
 CAST(coalesce(sum(n) FILTER (WHERE true_idx=k.class_index),0) AS BIGINT) AS true_support,
 CAST(coalesce(sum(n) FILTER (WHERE pred_idx=k.class_index),0) AS BIGINT) AS predicted_support,
 CAST(coalesce(sum(n) FILTER (WHERE true_idx=k.class_index AND pred_idx=k.class_index),0) AS BIGINT) AS true_positives
 FROM {groups} LEFT JOIN {source} x ON (x.true_idx=k.class_index OR x.pred_idx=k.class_index){same}
 GROUP BY ALL"""


def class_metrics(source: str, by: str = "") -> str:
    return f"""SELECT *, coalesce(CASE WHEN precision+recall>0 THEN round(2*precision*recall/(precision+recall),4) END,
 CASE WHEN true_support>0 THEN 0.0 END)::DOUBLE AS f1_score, true_support=0 AS zero_test_support,
 predicted_support=0 AS zero_predictions FROM (SELECT *,
 round(true_positives::DOUBLE/nullif(predicted_support,0),4) AS precision,
 round(true_positives::DOUBLE/nullif(true_support,0),4) AS recall FROM ({support(source, by)}))"""


def overall_metrics(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""

    def half_up(total, rows):
        # integer arithmetic on ten-thousandths
        return f"coalesce(((2*({total})+{rows})//nullif(2*({rows}),0))::DOUBLE/10000,0)"

    def units(c):
        return f"CAST(round(coalesce({c},0)*10000) AS BIGINT)"

    def macro(c):
        return half_up(f"sum({units(c)}) FILTER (WHERE true_support>0)", "count(*) FILTER (WHERE true_support>0)")

    def weighted(c):
        return half_up(f"sum({units(c)}*true_support)", "sum(true_support)")

    return f"""SELECT {lead}CAST(sum(true_support) AS BIGINT) AS total_evaluated_samples,
 coalesce(round(sum(true_positives)::DOUBLE/nullif(sum(true_support),0),4),0) AS overall_accuracy,
 coalesce(round(max(true_support)::DOUBLE/nullif(sum(true_support),0),4),0) AS majority_class_baseline_accuracy,
 {macro('f1_score')} AS macro_f1, {weighted('f1_score')} AS weighted_f1, {weighted('precision')} AS weighted_precision,
 {weighted('recall')} AS weighted_recall, {macro('recall')} AS balanced_accuracy FROM {source}{group}"""


def binary_metrics(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""

    def total(cond):
        return f"CAST(coalesce(sum(n) FILTER (WHERE {cond}),0) AS BIGINT)"

    return f"""SELECT *, coalesce(round(2*attack_precision*attack_detection_rate/
 nullif(attack_precision+attack_detection_rate,0),4),0) AS attack_f1_score FROM (SELECT *,
 coalesce(round(false_positives_alarms::DOUBLE/nullif(benign_total,0),4),0) AS false_alarm_rate,
 coalesce(round(true_negatives_benign::DOUBLE/nullif(benign_total,0),4),0) AS benign_recall,
 coalesce(round(true_positives_detected::DOUBLE/nullif(attack_total,0),4),0) AS attack_detection_rate,
 coalesce(round(true_positives_detected::DOUBLE/nullif(true_positives_detected+false_positives_alarms,0),4),0) AS attack_precision
 FROM (SELECT {lead}{total('true_idx=0')} AS benign_total, {total('true_idx<>0')} AS attack_total,
 {total('true_idx=0 AND pred_idx=0')} AS true_negatives_benign,
 {total('true_idx=0 AND pred_idx<>0')} AS false_positives_alarms,
 {total('true_idx<>0 AND pred_idx=0')} AS false_negatives_missed,
 {total('true_idx<>0 AND pred_idx<>0')} AS true_positives_detected FROM {source}{group}))"""


def one_vs_rest(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""

    def rate(a, b):
        return f"coalesce({a}::DOUBLE/nullif({a}+{b},0),0)"

    return f"""SELECT {lead}class_index, class_name, support, predicted_support, tp, fp, fn, tn, round(p,4) AS precision,
 round(r,4) AS recall, round(coalesce(2*p*r/nullif(p+r,0),0),4) AS f1_score, round({rate('tn','fp')},4) AS specificity,
 round({rate('fp','tn')},4) AS fpr, round({rate('fn','tp')},4) AS fnr FROM (
 SELECT *, {rate('tp','fp')} AS p, {rate('tp','fn')} AS r FROM (
 SELECT {lead}class_index, class_name, true_support AS support, predicted_support, true_positives AS tp,
 predicted_support-true_positives AS fp, true_support-true_positives AS fn,
 CAST(sum(true_support) OVER ({over}) AS BIGINT)-predicted_support-true_support+true_positives AS tn
 FROM ({support(source, by)})))"""


cte("cells", cells("predictions"), "predictions")
cte("split_cells", cells("predictions", "split"), "predictions")
cte("metrics", class_metrics("cells"), "cells", "classes")
cte("split_metrics", class_metrics("split_cells", "split"), "split_cells", "classes")
cte("rule_cells", "SELECT rule, true_idx, pred_idx, n FROM (" + cells("adjusted", "'baseline' AS rule", "prediction")
    + ") UNION ALL SELECT rule, true_idx, pred_idx, n FROM (" + cells("adjusted", "'policy' AS rule", "adjusted_prediction")
    + ")", "adjusted")
cte("rule_metrics", class_metrics("rule_cells", "rule"), "rule_cells", "classes")
cte("dense", """SELECT split, t.class_index AS true_idx, p.class_index AS pred_idx, t.class_name AS true_label,
 p.class_name AS predicted_label, CAST(coalesce(n,0) AS BIGINT) AS raw_count,
 CAST(sum(coalesce(n,0)) OVER (PARTITION BY split, t.class_index) AS BIGINT) AS true_class_support,
 coalesce(round(coalesce(n,0)::DOUBLE/nullif(sum(coalesce(n,0)) OVER (PARTITION BY split, t.class_index),0),4),0) AS normalized_ratio
 FROM (SELECT DISTINCT split FROM split_cells) g CROSS JOIN classes t CROSS JOIN classes p
 LEFT JOIN split_cells c USING (split) """.replace("USING (split) ", "ON c.split=g.split AND c.true_idx=t.class_index AND c.pred_idx=p.class_index")
    .replace("SELECT split,", "SELECT g.split,", 1).replace("PARTITION BY split,", "PARTITION BY g.split,"),
    "split_cells", "classes")
