"""The registry, the ``packets`` view over the given tables, and one column contract for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The given events are minutes apart, so slices and windows are wider than the capture defaults.
SLICE = "1 day"
WINDOW = "1 hour"
RTT_TIMEOUT = "40 days"

# Packets derived from the given events; {K} is the engine's way to read the number in ``props``.
_PACKETS = """
WITH e AS (
  SELECT event_id, cast(ts AS timestamp) AS ts, user_id AS u, event_type, value, cast({K} AS int) AS k FROM {EVENTS}
), c AS (
  SELECT e.*, (event_id % 3 = 0) AS is_reply,
    '172.19.102.' || cast(u % 40 + 1 AS string) AS cli_ip,
    CASE WHEN k % 5 = 0 THEN '10.0.0.' || cast(k % 2 + 1 AS string)
         ELSE '93.184.216.' || cast(k % 3 + 1 AS string) END AS srv_ip,
    cast(40000 + u % 4 AS int) AS cli_port,
    CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 22 WHEN 'purchase' THEN 1433 ELSE 53 END AS srv_port,
    (event_type = 'error') AS is_udp
  FROM e
)
SELECT event_id AS frame_no, ts AS timestamp,
  CASE WHEN is_reply THEN srv_ip ELSE cli_ip END AS src_ip,
  CASE WHEN is_reply THEN cli_ip ELSE srv_ip END AS dst_ip,
  CASE WHEN is_reply THEN srv_port ELSE cli_port END AS src_port,
  CASE WHEN is_reply THEN cli_port ELSE srv_port END AS dst_port,
  CASE WHEN is_udp THEN 'DNS' WHEN k % 2 = 0 THEN 'TCP' WHEN event_type = 'click' THEN 'HTTP'
       WHEN event_type = 'view' THEN 'TLS' WHEN event_type = 'signup' THEN 'SSH' ELSE 'TDS' END AS protocol,
  cast(least(9000, 54 + floor(value * 4)) AS int) AS frame_len,
  cast(least(9000, 54 + floor(value * 4)) AS int) - 14 AS ip_len,
  CASE WHEN is_udp THEN NULL WHEN k % 10 = 0 AND is_reply THEN 18 WHEN k % 10 = 0 THEN 2
       WHEN k % 10 = 9 THEN 41 WHEN k % 10 = 8 THEN 0 WHEN k % 10 = 7 THEN 4 WHEN k % 10 = 6 THEN 17
       WHEN k % 2 = 0 THEN 16 ELSE 24 END AS tcp_flags,
  CASE WHEN is_udp THEN NULL ELSE event_id % 50 END AS tcp_seq,
  CASE WHEN is_udp THEN NULL ELSE event_id % 250 END AS tcp_ack,
  md5(cast(event_id AS string)) AS payload,
  CASE WHEN is_udp THEN substr(md5(cast(k AS string)), 1, k % 16 + 3) || '.example.' ||
       CASE k % 4 WHEN 0 THEN 'tk' WHEN 1 THEN 'com' WHEN 2 THEN 'net' ELSE 'ml' END END AS dns_qry_name,
  CASE WHEN is_udp THEN 1 END AS dns_qry_type,
  CASE WHEN is_udp THEN k % 3 END AS dns_an_count,
  CASE WHEN is_udp AND k % 3 = 2 THEN '1.2.3.4,5.6.7.8' WHEN is_udp AND k % 3 = 1 THEN '1.2.3.4' END AS dns_response_ip,
  CASE WHEN event_type = 'click' AND NOT is_reply THEN CASE k % 3 WHEN 0 THEN 'POST' ELSE 'GET' END END AS http_request_method,
  CASE WHEN event_type = 'click' AND NOT is_reply THEN '/p/' || cast(k AS string) || '?q=' || md5(cast(k AS string)) END AS http_request_uri,
  CASE WHEN event_type = 'click' AND NOT is_reply THEN 'agent/' || cast(k % 4 AS string) END AS http_user_agent,
  CASE WHEN event_type = 'click' AND is_reply THEN 200 + 100 * (k % 4) END AS http_response_code,
  CASE WHEN event_type = 'purchase' THEN 'select * from t where id=' || cast(k AS string) ||
       CASE WHEN k % 10 = 0 THEN '; DROP TABLE t --' ELSE '' END END AS sql_query,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN '2.0' ELSE '1.99' END END AS ssh_protocol,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 5 = 0 THEN 'SSH-2.0-OpenSSH_7.4' ELSE 'SSH-2.0-OpenSSH_9.6' END END AS ssh_server_version,
  CASE WHEN event_type = 'view' THEN '771,' || cast(k % 6 AS string) || '-49195,0-23,29,0' END AS tls_ja3
FROM c
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The given times carry no zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Generated rows stop filters from pulling the JSON call below them, where it would run once per mention.
    once = "{events} LATERAL VIEW explode(array(get_json_object(props, '$.k'))) AS number"
    text = _PACKETS.replace("{K}", "number").replace("{EVENTS}", once)
    return spark.sql(text, events=table(spark, sf_dir, "events"))


# Named oracle steps. A query lists the ones it reads; each may read those before it.
STEPS: dict[str, str] = {
    "packets": _PACKETS.replace("{K}", "json_extract_string(props, '$.k')").replace("{EVENTS}", "events"),
}

def _rounded(c: Column, scale: float) -> Column:
    """Rounding in plain double arithmetic, the same steps in both engines."""
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale


_SPARK_KIND: dict[str, Callable[[Column], Column]] = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("bigint"),
    "f": lambda c: _rounded(c, 1e6),
    "g": lambda c: _rounded(c, 1e2),
    "t": lambda c: F.unix_micros(c),
}
_DUCK_KIND = {
    "s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "f": "floor(CAST({0} AS DOUBLE) * 1e6 + 0.5) / 1e6 + 0.0",
    "g": "floor(CAST({0} AS DOUBLE) * 1e2 + 0.5) / 1e2 + 0.0", "t": "epoch_us({0})",
}


def _contract(columns: str) -> list[tuple[str, str]]:
    """'a b:f c:t' -> [(a, i), (b, f), (c, t)]; the default kind is a whole number."""
    return [(c.split(":")[0], (c.split(":") + ["i"])[1]) for c in columns.split()]


def shaped(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[_SPARK_KIND[kind](F.col(name)).alias(name) for name, kind in _contract(columns)])


def oracle(columns: str, body: str, steps: str = "packets") -> str:
    parts = ", ".join(f"{name} AS ({STEPS[name]})" for name in steps.split())
    out = ", ".join(f"{_DUCK_KIND[kind].format(name)} AS {name}" for name, kind in _contract(columns))
    return f"{'WITH ' + parts if parts else ''} SELECT {out} FROM ({body}) AS result"


def query(name: str, columns: str, sql: str | None = None, steps: str = "packets"):
    """Register a query under ``name``. ``columns`` fixes names and kinds of the result for both engines."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(spark, sf_dir), columns)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(columns, sql, steps)
        return fn

    return register
