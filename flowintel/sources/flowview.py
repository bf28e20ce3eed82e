"""Raw-flow shaped view over the TPC-H-like `lineitem` table, with all columns of a capture.

Gives every operator flow records to run on where no flow capture is at hand: all labels,
repeated header rows, an unknown label and every kind of bad token.  Each output column
is text, as in a CSV capture, and a pure function of one input row.  The expressions use
only SQL that Spark and other engines read alike; `{s}` is the text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.session import limit_methods, spread

KEY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]

DERIVED = {
    "m": "(l_orderkey*31+l_linenumber*17+l_partkey*7)%1000",
    "d": "(l_orderkey*13+l_partkey)%8",
    "sec": "(l_orderkey*37+l_partkey*11+l_linenumber*101)%86400",
    "q": "(l_orderkey+l_partkey)%200",
}
DAY = (
    "CASE d WHEN 0 THEN '14/02/2018' WHEN 1 THEN '15/02/2018' WHEN 2 THEN '16/02/2018' WHEN 3 THEN '21/02/2018' "
    "WHEN 4 THEN '22/02/2018' WHEN 5 THEN '28/02/2018' WHEN 6 THEN '01/03/2018' ELSE '02/03/2018' END"
)
# snake-case column -> expression over the derived keys, where the meaning of the column matters
_SPECIAL = {
    "dst_port": (
        "CASE WHEN m<700 THEN CASE l_suppkey%6 WHEN 0 THEN '53' WHEN 1 THEN '443' WHEN 2 THEN '80' "
        "WHEN 3 THEN '445' WHEN 4 THEN '3389' ELSE '0' END WHEN m>=840 AND m<880 THEN '8080' "
        "WHEN m>=880 AND m<907 THEN '21' WHEN m>=907 AND m<933 THEN '22' "
        "WHEN m>=933 AND m<955 THEN cast(50890+l_suppkey%10 AS {s}) ELSE '80' END"
    ),
    "protocol": "CASE l_linenumber%3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '0' END",
    "timestamp": (
        "CASE WHEN q=13 THEN 'not_a_timestamp' WHEN q=14 THEN '2018-02-15 10:20:30' WHEN q=15 THEN null "
        "ELSE concat(day_s,' ',lpad(cast(cast(floor(sec/3600) as int) as {s}),2,'0'),':',"
        "lpad(cast(cast(floor((sec%3600)/60) as int) as {s}),2,'0'),':',lpad(cast(sec%60 as {s}),2,'0')) END"
    ),
    "flow_duration": "CASE WHEN q=5 THEN '-1' WHEN q<5 THEN '0' WHEN q=12 THEN '' ELSE cast(sec*1000 AS {s}) END",
    "tot_fwd_pkts": "CASE WHEN q>=6 AND q<=9 THEN '0' ELSE cast(cast(l_quantity as int) as {s}) END",
    "tot_bwd_pkts": "cast(m%11 AS {s})",
    "totlen_fwd_pkts": "cast(cast(l_extendedprice as decimal(12,2)) as {s})",
    "totlen_bwd_pkts": "cast(l_partkey%1500 AS {s})",
    "fwd_pkt_len_mean": "cast(l_partkey%900 AS {s})",
    "bwd_pkt_len_mean": "cast(l_suppkey%700 AS {s})",
    "flow_byts_s": (
        "CASE q WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN' WHEN 2 THEN '' WHEN 3 THEN '-inf' WHEN 4 THEN null "
        "ELSE cast(l_orderkey%9000 AS {s}) END"
    ),
    "flow_pkts_s": "CASE WHEN q<3 THEN '+Infinity' ELSE cast(l_orderkey%5000 AS {s}) END",
    "fwd_iat_tot": "cast(sec*1000+l_linenumber AS {s})",
    "bwd_psh_flags": "cast(l_linenumber*0 AS {s})",
    "fwd_pkts_s": "CASE WHEN q=16 THEN 'inf' ELSE cast(l_partkey%300 AS {s}) END",
    "bwd_pkts_s": "CASE WHEN q=17 THEN 'nan' ELSE cast(l_suppkey%200 AS {s}) END",
    "pkt_len_mean": "cast((l_partkey*3+l_suppkey)%1400 AS {s})",
    "down_up_ratio": "CASE WHEN q=10 THEN 'nan' WHEN q=11 THEN null ELSE cast(l_linenumber%5 AS {s}) END",
    "pkt_size_avg": "cast((l_partkey*3+l_suppkey)%1400+l_linenumber*40 AS {s})",
    "fwd_seg_size_avg": "cast(l_partkey%900 AS {s})",
    "bwd_seg_size_avg": "cast(l_suppkey%700+m AS {s})",
    "subflow_fwd_pkts": "CASE WHEN q>=6 AND q<=9 THEN '0' ELSE cast(cast(l_quantity as int) as {s}) END",
    "subflow_fwd_byts": "cast(cast(l_extendedprice as decimal(12,2)) as {s})",
    "subflow_bwd_pkts": "cast(m%11 AS {s})",
    "subflow_bwd_byts": "cast(l_partkey%1500 AS {s})",
    "label": (
        "CASE WHEN m<700 THEN 'Benign' WHEN m<780 THEN 'DDOS attack-HOIC' WHEN m<840 THEN 'DoS attacks-Hulk' "
        "WHEN m<880 THEN 'Bot' WHEN m<907 THEN 'FTP-BruteForce' WHEN m<933 THEN 'SSH-Bruteforce' "
        "WHEN m<955 THEN 'Infilteration' WHEN m<974 THEN 'DoS attacks-SlowHTTPTest' "
        "WHEN m<980 THEN 'DoS attacks-GoldenEye' WHEN m<986 THEN 'DoS attacks-Slowloris' "
        "WHEN m<990 THEN 'DDOS attack-LOIC-UDP' WHEN m<993 THEN 'Brute Force -Web' "
        "WHEN m<995 THEN 'Brute Force -XSS' WHEN m<996 THEN 'SQL Injection' "
        "WHEN m<998 THEN 'ZeroDay (unknown)' ELSE 'Label' END"
    ),
    "flow_iat_mean": "CASE WHEN q=19 THEN 'NaN' WHEN q=20 THEN '-Infinity' ELSE cast(sec*3+m AS {s}) END",
    "init_fwd_win_byts": "CASE WHEN q=21 THEN '-1' WHEN q=22 THEN null ELSE cast((l_partkey*7)%65536 AS {s}) END",
    "init_bwd_win_byts": "CASE WHEN q=23 THEN 'inf' ELSE cast((l_suppkey*11+m)%65536 AS {s}) END",
    "rst_flag_cnt": "CASE WHEN q=18 THEN '' ELSE cast(m%2 AS {s}) END",
}


def _plain(place: int) -> str:
    """A count or size that differs from column to column: mixed multiples of the keys below a limit of its own."""
    return f"cast((l_partkey*{place % 7 + 1}+l_suppkey*{place % 5 + 2}+l_linenumber*{place}+m)%{100 + 37 * place} AS {{s}})"


# all columns in file order, then the file
EXPRESSIONS = {
    snake: "cast(l_linenumber*0 AS {s})" if snake in dims.CONSTANT_COLUMNS else _SPECIAL.get(snake, _plain(place))
    for place, snake in enumerate(dims.RAW_BY_SNAKE)
}
EXPRESSIONS["source_file"] = "concat('flows-',replace(day_s,'/','-'),'.csv')"


def lineitem_flows(
    spark: SparkSession, sf_dir: str, keep: list[str] | None = None, share: tuple[int, int] = (0, 1),
) -> DataFrame:
    """Raw flows (CSV column names, all text) plus `source_file`; `keep` adds lineitem columns.

    `share` (i, n) gives the i-th of n shares by hash, which together are all rows.
    """
    limit_methods(spark)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEY_COLUMNS)
    if share[1] > 1:
        rows = rows.where(F.pmod(F.xxhash64(*KEY_COLUMNS), F.lit(share[1])) == share[0])
    keys = spread(rows).selectExpr(
        *KEY_COLUMNS, *[f"{expr} AS {name}" for name, expr in DERIVED.items()]
    )
    days = keys.selectExpr("*", f"{DAY} AS day_s")
    columns = [
        f"{expr.format(s='string')} AS `{dims.RAW_BY_SNAKE.get(name, name)}`" for name, expr in EXPRESSIONS.items()
    ]
    return days.selectExpr(*columns, *(keep or []))
