"""Payment-shaped views over the test tables, in one SQL text for Spark and for the SQL oracle.

Only the expressions in ``DIALECT`` differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklane.session import pin_utc

DIALECT = {
    "spark": {
        "event_seconds": "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)",
        "k": "CAST(get_json_object(props, '$.k') AS int)",
        "order_seconds": "timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)",
    },
    "oracle": {
        "event_seconds": "CAST(floor(epoch(ts)) AS BIGINT) - 1704067200",
        "k": "CAST(json_extract_string(props, '$.k') AS INT)",
        "order_seconds": "CAST(epoch(o_orderdate) AS BIGINT) - 788918400",
    },
}

# name -> (tables or views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Card payments; a third of the columns have nulls and sparse1 is 90% null.
    "txn": (("events",), """
        SELECT event_id AS TransactionID, {event_seconds} AS TransactionDT, value AS TransactionAmt,
          CAST(round(value * 100) AS BIGINT) AS cents, user_id AS card1,
          CASE event_id % 5 WHEN 0 THEN 'W' WHEN 1 THEN 'C' WHEN 2 THEN 'R' WHEN 3 THEN 'H' ELSE 'S' END AS ProductCD,
          CASE k % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'discover'
                     WHEN 3 THEN 'american express' END AS card4,
          CASE WHEN k % 3 = 2 THEN 'credit' ELSE 'debit' END AS card6,
          CASE k % 7 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'hotmail.com'
                     WHEN 3 THEN 'outlook.com' WHEN 4 THEN 'mail.com' END AS P_emaildomain,
          CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END AS DeviceType,
          CASE WHEN k % 4 <> 0 THEN CAST(100 + k AS DOUBLE) END AS addr1,
          CASE WHEN k % 9 <> 0 THEN CAST(80 + k % 9 AS DOUBLE) END AS addr2,
          CASE WHEN event_id % 10 = 0 THEN value END AS sparse1,
          CASE CAST(floor(event_id / 5) AS BIGINT) % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD'
               WHEN 2 THEN 'NETBANKING' ELSE 'WALLET' END AS tx_type,
          CASE WHEN event_type = 'error' AND k % 6 = 0 THEN 1 ELSE 0 END AS isFraud,
          event_type
        FROM (SELECT *, {k} AS k FROM events) e"""),
    # Day-grain times on twenty cards, so most rows tie with an earlier one.
    "txn_orders": (("orders",), """
        SELECT o_orderkey AS TransactionID, {order_seconds} AS TransactionDT,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey % 20 AS card1,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS isFraud
        FROM orders"""),
    "identity": (("orders",), """
        SELECT o_orderkey AS TransactionID, o_orderkey % 100 AS id_01, o_orderpriority AS DeviceInfo
        FROM orders WHERE o_orderkey % 4 = 0"""),
    # Deterministic scores in thousandths. score_cal is a monotone map of the raw score.
    "scored": (("txn",), """
        SELECT *, CAST(milli AS DOUBLE) / 1000 AS score_raw,
          CAST(CAST(floor(milli * milli / 1000) AS BIGINT) AS DOUBLE) / 1000 AS score_cal,
          CAST(iso_milli AS DOUBLE) / 1000 AS iso_score
        FROM (SELECT TransactionID, TransactionDT, TransactionAmt, card1, ProductCD, tx_type, isFraud,
                CASE WHEN isFraud = 1 THEN 200 + CAST(floor(x * 8 / 10) AS BIGINT)
                     ELSE CAST(floor(x * x / 1500) AS BIGINT) END AS milli,
                (TransactionID * 104729) % 1000 AS iso_milli
              FROM (SELECT *, (TransactionID * 7919) % 1000 AS x FROM txn) a) b"""),
    # Logged gateway outcomes of three routing policies.
    "outcomes": (("txn",), """
        SELECT TransactionID + 1 AS step,
          CASE TransactionID % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS policy, tx_type,
          CASE CAST(floor(TransactionID / 20) AS BIGINT) % 4 WHEN 0 THEN 'Razorpay' WHEN 1 THEN 'PayU'
               WHEN 2 THEN 'Stripe' ELSE 'CCAvenue' END AS gateway,
          CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success, TransactionAmt AS amt,
          CAST((TransactionDT % 86400) AS DOUBLE) / 3600 AS hour
        FROM txn"""),
    # Conversation turns with a fraud-rate claim appended to some, to be checked against the data.
    "claims": (("conversations",), """
        SELECT conv_id, turn, role,
          CASE conv_id % 4
            WHEN 0 THEN text || ' About ' || CAST(turn + conv_id % 5 AS VARCHAR(20)) || '.5% fraud was seen.'
            WHEN 1 THEN text || ' Roughly 3% fraud here, but ' || CAST(9 + turn AS VARCHAR(20)) || ' % Fraud there.'
            WHEN 2 THEN text || ' Which card type has the highest fraud rate?'
            ELSE text END AS text
        FROM conversations"""),
}

# Reference success rates by gateway and payment type (fixed values).
RATES = """
  SELECT * FROM (VALUES
    ('UPI','Razorpay',0.94), ('UPI','PayU',0.78), ('UPI','Stripe',0.65), ('UPI','CCAvenue',0.81),
    ('CARD','Razorpay',0.87), ('CARD','PayU',0.91), ('CARD','Stripe',0.95), ('CARD','CCAvenue',0.79),
    ('NETBANKING','Razorpay',0.83), ('NETBANKING','PayU',0.88), ('NETBANKING','Stripe',0.71), ('NETBANKING','CCAvenue',0.92),
    ('WALLET','Razorpay',0.91), ('WALLET','PayU',0.72), ('WALLET','Stripe',0.82), ('WALLET','CCAvenue',0.88)
  ) AS t(tx_type, gateway, rate)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the test table of that name."""
    pin_utc(spark)
    if name == "rates":
        return spark.sql(RATES).withColumn("rate", _double("rate"))
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    inputs, text = VIEWS[name]
    text = text.format(**DIALECT["spark"])
    for source in inputs:
        text = text.replace(f"FROM {source}", "FROM {" + source + "}")
    return spark.sql(text, **{source: view(spark, sf_dir, source) for source in inputs})


def _double(name):
    from pyspark.sql import functions as F
    return F.col(name).cast("double")


def with_views(names: str, query: str) -> str:
    """Oracle SQL: ``query`` preceded by the named views (space separated) and what they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered or (name != "rates" and name not in VIEWS):
            return
        for source in VIEWS[name][0] if name in VIEWS else ():
            add(source)
        ordered.append(name)

    for name in names.split():
        add(name)
    parts = [
        f"{name} AS ({RATES if name == 'rates' else VIEWS[name][1].format(**DIALECT['oracle'])})"
        for name in ordered
    ]
    body = query.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
