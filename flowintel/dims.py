"""Fixed reference data and the small DataFrames built from it.

Every table here has a size that is known at authoring time (at most 80 rows), so
joins against them are always safe to broadcast.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: raw CSV columns in file order -------------------------------------
RAW_COLUMNS = [
    "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts",
    "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max",
    "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std", "Bwd Pkt Len Max",
    "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std", "Flow Byts/s",
    "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max",
    "Flow IAT Min", "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std",
    "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags",
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Len",
    "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s", "Pkt Len Min",
    "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt",
    "ACK Flag Cnt", "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt",
    "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
    "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg",
    "Bwd Pkts/b Avg", "Bwd Blk Rate Avg", "Subflow Fwd Pkts", "Subflow Fwd Byts",
    "Subflow Bwd Pkts", "Subflow Bwd Byts", "Init Fwd Win Byts", "Init Bwd Win Byts",
    "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean", "Active Std",
    "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max",
    "Idle Min", "Label",
]


def snake_name(raw: str) -> str:
    """Column naming rule: lower case, blanks and slashes become underscores."""
    return raw.lower().replace(" ", "_").replace("/", "_")


COLUMN_MAPPING = {raw: snake_name(raw) for raw in RAW_COLUMNS}
RAW_BY_SNAKE = {snake: raw for raw, snake in COLUMN_MAPPING.items()}

# --- Fixed values: raw label -> canonical label --------------------------------------
LABEL_MAPPING = {
    "Benign": "Benign",
    "Bot": "Bot",
    "Brute Force -Web": "Brute Force - Web",
    "Brute Force -XSS": "Brute Force - XSS",
    "DDOS attack-HOIC": "DDoS-HOIC",
    "DDOS attack-LOIC-UDP": "DDoS-LOIC-UDP",
    "DoS attacks-GoldenEye": "DoS-GoldenEye",
    "DoS attacks-Hulk": "DoS-Hulk",
    "DoS attacks-SlowHTTPTest": "DoS-SlowHTTPTest",
    "DoS attacks-Slowloris": "DoS-Slowloris",
    "FTP-BruteForce": "FTP-BruteForce",
    "Infilteration": "Infiltration",
    "SQL Injection": "SQL Injection",
    "SSH-Bruteforce": "SSH-BruteForce",
}

# Class index = position in the alphabetical list of canonical labels (Benign is 0).
CLASS_LABELS = list(LABEL_MAPPING.values())
CLASS_INDEX = {label: idx for idx, label in enumerate(CLASS_LABELS)}
NUM_CLASSES = len(CLASS_LABELS)
BENIGN = "Benign"
UNKNOWN = "UNKNOWN"

# --- Fixed values: text tokens that stand for a missing or non-finite number ---------
POS_INF_TOKENS = ["Infinity", "+Infinity", "inf", "+inf"]
NEG_INF_TOKENS = ["-Infinity", "-inf"]
NAN_TOKENS = ["NaN", "nan"]

# --- Fixed values: column groups -----------------------------------------------------
RATE_COLUMNS = ["flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s"]
RATIO_COLUMN = "down_up_ratio"
INT_COLUMNS = ["dst_port", "protocol"]
PROFILED_COLUMNS = [
    "Flow Byts/s", "Flow Pkts/s", "Flow Duration", "Fwd Pkts/s", "Bwd Pkts/s",
    "Tot Fwd Pkts", "Tot Bwd Pkts", "Flow IAT Mean", "Init Fwd Win Byts",
    "Init Bwd Win Byts", "RST Flag Cnt", "Down/Up Ratio",
]
INTEGRITY_COLUMNS = ["flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "flow_byts_s", "flow_pkts_s"]
CONSTANT_COLUMNS = [
    "bwd_psh_flags", "bwd_urg_flags", "fwd_byts_b_avg", "fwd_pkts_b_avg",
    "fwd_blk_rate_avg", "bwd_byts_b_avg", "bwd_pkts_b_avg", "bwd_blk_rate_avg",
]
METADATA_COLUMNS = [
    "label", "raw_label", "label_idx", "timestamp", "timestamp_parsed",
    "event_date", "source_file", "split", "split_pct", "weight",
]
SHORTCUT_COLUMNS = ["dst_port"]
COLLINEAR_COLUMNS = [
    "subflow_fwd_pkts", "subflow_bwd_pkts", "subflow_fwd_byts",
    "subflow_bwd_byts", "fwd_seg_size_avg", "bwd_seg_size_avg",
]
FEATURE_PAIRS = [
    ("tot_fwd_pkts", "subflow_fwd_pkts", "Forward packet count vs Subflow forward packet count"),
    ("tot_bwd_pkts", "subflow_bwd_pkts", "Backward packet count vs Subflow backward packet count"),
    ("totlen_fwd_pkts", "subflow_fwd_byts", "Forward total bytes vs Subflow forward bytes"),
    ("totlen_bwd_pkts", "subflow_bwd_byts", "Backward total bytes vs Subflow backward bytes"),
    ("fwd_pkt_len_mean", "fwd_seg_size_avg", "Forward packet length mean vs Forward segment size average"),
    ("bwd_pkt_len_mean", "bwd_seg_size_avg", "Backward packet length mean vs Backward segment size average"),
    ("pkt_len_mean", "pkt_size_avg", "Packet length mean vs Packet size average"),
    ("flow_duration", "fwd_iat_tot", "Flow duration vs Forward total inter-arrival time"),
    ("flow_pkts_s", "flow_byts_s", "Flow packet rate vs Flow byte rate"),
]
NEAR_DUPLICATE_R = 0.999
STRONG_R = 0.85

# --- Fixed values: ports -------------------------------------------------------------
PORT_SERVICES = {
    21: "FTP (File Transfer)",
    22: "SSH (Secure Shell)",
    53: "DNS (Domain Name System)",
    80: "HTTP (Web Traffic)",
    88: "Kerberos",
    135: "RPC / Windows Endpoint",
    139: "NetBIOS",
    389: "LDAP",
    443: "HTTPS (Encrypted Web)",
    445: "SMB / Microsoft-DS",
    1433: "MSSQL Database",
    3306: "MySQL Database",
    3389: "RDP (Remote Desktop)",
    5432: "PostgreSQL Database",
    8080: "HTTP-Alt / Web Proxy",
    8443: "HTTPS-Alt",
}
PORT_CRITICALITY = {21: 95, 22: 100, 443: 95, 80: 70, 8080: 70, 3306: 100, 5432: 100}
DEFAULT_CRITICALITY = 50
EXTREME_PORT_PCT = 90.0
MATRIX_PORTS = [0, 21, 22, 53, 80, 443, 445, 3389, 8080, 50891, 50896, 50899]

# --- Fixed values: observation windows -----------------------------------------------
CAMPAIGN_DATES = [
    "2018-02-14", "2018-02-15", "2018-02-16", "2018-02-21",
    "2018-02-22", "2018-02-28", "2018-03-01", "2018-03-02",
]
CAMPAIGN_START = "2018-02-14T00:00:00"
CAMPAIGN_END = "2018-03-03T00:00:00"
# units per window: observed dates, hours of a day, five-minute buckets of an hour
RECURRENCE_DENOMINATORS = {"full_campaign": 8, "daily": 24, "hourly": 12}
INTER_DAY_TRAIN = ["2018-02-14", "2018-02-15", "2018-02-16", "2018-02-21"]
INTER_DAY_VAL = ["2018-02-22"]
RARE_SUPPORT = 10000
ULTRA_RARE_SUPPORT = 500

# --- Fixed values: risk score --------------------------------------------------------
WEIGHT_SEVERITY = 0.40
WEIGHT_FREQUENCY = 0.25
WEIGHT_RECURRENCE = 0.20
WEIGHT_TARGET_IMPACT = 0.15
MAX_REFERENCE_FLOWS = 1_000_000
DEFAULT_SEVERITY = 50.0
SEVERITY_PRIORS = {
    "Benign": 0.0,
    "Infiltration": 90.0,
    "Bot": 85.0,
    "SQL Injection": 80.0,
    "DDoS-HOIC": 75.0,
    "DDoS-LOIC-UDP": 75.0,
    "DoS-Hulk": 70.0,
    "DoS-GoldenEye": 70.0,
    "DoS-SlowHTTPTest": 65.0,
    "DoS-Slowloris": 65.0,
    "SSH-BruteForce": 60.0,
    "FTP-BruteForce": 60.0,
    "Brute Force - Web": 55.0,
    "Brute Force - XSS": 55.0,
}

# --- Fixed values: reliability gates and decision thresholds -------------------------
MIN_SUPPORT = 30
HIGH_SUPPORT = 100
EVALUABLE_METRIC = 0.60
HIGH_METRIC = 0.75
TAU_BY_CLASS = {11: 0.60, 2: 0.35}

# --- Fixed values: technique mappings ------------------------------------------------
# (label, technique id, technique name, tactic, mapping status, rationale, missing telemetry)
TECHNIQUE_MAPPINGS = [
    ("Benign", None, None, None, "not_applicable",
     "Benign baseline network traffic without adversary activity.", []),
    ("Bot", "T1071.001", "Application Layer Protocol: Web Protocols", "Command and Control", "unverified",
     "Netflow captures periodic outbound communication patterns consistent with C2 beaconing, but lacks "
     "application-layer payload and host process context to verify command-and-control protocol structure.",
     ["Application layer payload content", "HTTP request URI and headers", "Endpoint process execution tree"]),
    ("Brute Force - Web", "T1110.001", "Password Guessing", "Credential Access", "candidate",
     "Repetitive short HTTP TCP flows targeting web ports (80/8080) characteristic of automated password "
     "spraying/guessing.",
     ["HTTP 401/403 response error status codes", "Web application authentication endpoint logs"]),
    ("Brute Force - XSS", "T1110.001", "Password Guessing", "Credential Access", "candidate",
     "Dataset artifact labeled as brute force attack leveraging automated submission tools against web "
     "input vectors.",
     ["HTTP request parameters and POST body", "Web application response logs"]),
    ("DDoS-HOIC", "T1498.001", "Network Denial of Service: Direct Network Flood", "Impact", "candidate",
     "High-volume distributed HTTP flood from multiple source addresses exhausting network bandwidth and "
     "connection pools.",
     ["Upstream link saturation telemetries", "Web server connection backlog metrics"]),
    ("DDoS-LOIC-UDP", "T1498.001", "Network Denial of Service: Direct Network Flood", "Impact", "candidate",
     "High-rate volumetric UDP packet flood targeting endpoint services.",
     ["Router interface discard counters", "Per-link bandwidth saturation telemetry"]),
    ("DoS-GoldenEye", "T1499.003", "Endpoint Denial of Service: Application Exhaustion Flood", "Impact", "candidate",
     "Application-layer HTTP Keep-Alive and Cache-Control abuse keeping sockets open and depleting worker "
     "thread pools.",
     ["Web server worker thread status", "Connection pool exhaustion logs"]),
    ("DoS-Hulk", "T1499.003", "Endpoint Denial of Service: Application Exhaustion Flood", "Impact", "candidate",
     "High-rate HTTP GET flood with randomized user-agents and cache-busting headers exhausting web "
     "application request queues.",
     ["Web server queue depth", "Endpoint CPU and memory consumption metrics"]),
    ("DoS-SlowHTTPTest", "T1499.003", "Endpoint Denial of Service: Application Exhaustion Flood", "Impact",
     "candidate",
     "Slow HTTP POST/headers holding web connections open until limits are reached.",
     ["Active TCP connection table holding durations", "Web server timeout logs"]),
    ("DoS-Slowloris", "T1499.003", "Endpoint Denial of Service: Application Exhaustion Flood", "Impact",
     "candidate",
     "Periodic partial HTTP request headers keeping connections open indefinitely.",
     ["Concurrent open socket states", "Web server timeout logs"]),
    ("FTP-BruteForce", "T1110.001", "Password Guessing", "Credential Access", "candidate",
     "High-frequency TCP connection attempts on port 21 characteristic of automated credential dictionary "
     "attacks.",
     ["FTP server daemon authentication logs", "Failed login error 530 records"]),
    ("Infiltration", "T1190", "Exploit Public-Facing Application", "Initial Access", "unverified",
     "Simulated client-side software exploitation followed by pivot; Netflow alone cannot verify binary "
     "exploit payloads or host execution traces.",
     ["Host process audit logs", "Endpoint EDR alerts", "Packet payloads"]),
    ("SQL Injection", "T1190", "Exploit Public-Facing Application", "Initial Access", "unverified",
     "Web application vulnerability exploitation requiring payload inspection; Netflow only observes packet "
     "sizes and inter-arrival times without SQL query visibility.",
     ["Decrypted HTTP request URI and body", "WAF inspection alerts", "Database error and audit logs"]),
    ("SSH-BruteForce", "T1110.001", "Password Guessing", "Credential Access", "candidate",
     "Repetitive rapid TCP handshakes on port 22 matching SSH credential brute forcing.",
     ["sshd auth.log failed password attempts"]),
]
FALLBACK_STATUS = "unverified"
FALLBACK_RATIONALE = "Unrecognized or unmapped traffic category without verified attack evidence."
FALLBACK_TELEMETRY = ["Ground truth telemetry and payload captures"]


def label_map(spark: SparkSession) -> DataFrame:
    """raw_label -> canonical_label (14 rows)."""
    return spark.createDataFrame(pa.table({
        "raw_label": list(LABEL_MAPPING.keys()),
        "canonical_label": list(LABEL_MAPPING.values()),
    }))


def classes(spark: SparkSession) -> DataFrame:
    """class_index, class_name (14 rows)."""
    return spark.createDataFrame(pa.table({
        "class_index": pa.array(range(NUM_CLASSES), pa.int32()),
        "class_name": CLASS_LABELS,
    }))


def port_services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "port": pa.array(list(PORT_SERVICES.keys()), pa.int32()),
        "known_service": list(PORT_SERVICES.values()),
    }))


def port_criticality(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "port": pa.array(list(PORT_CRITICALITY.keys()), pa.int32()),
        "known_criticality": pa.array(list(PORT_CRITICALITY.values()), pa.int32()),
    }))


def matrix_ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({"port": pa.array(MATRIX_PORTS, pa.int32())}))


def severity_priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "label": list(SEVERITY_PRIORS.keys()),
        "severity_prior": list(SEVERITY_PRIORS.values()),
    }))


def technique_mappings(spark: SparkSession) -> DataFrame:
    """label -> technique columns (14 rows)."""
    label, tid, name, tactic, status, why, telemetry = zip(*TECHNIQUE_MAPPINGS)
    return spark.createDataFrame(pa.table({
        "label": pa.array(label, pa.string()),
        "technique_id": pa.array(tid, pa.string()),
        "technique_name": pa.array(name, pa.string()),
        "tactic": pa.array(tactic, pa.string()),
        "mapping_status": pa.array(status, pa.string()),
        "rationale": pa.array(why, pa.string()),
        "missing_telemetry": pa.array(telemetry, pa.list_(pa.string())),
    }))


def thresholds(spark: SparkSession, taus: dict[int, float] | None = None) -> DataFrame:
    """class_index -> tau for the decision policy."""
    taus = TAU_BY_CLASS if taus is None else taus
    return spark.createDataFrame(pa.table({
        "class_index": pa.array(list(taus.keys()), pa.int32()),
        "tau": pa.array(list(taus.values()), pa.float64()),
    }))
