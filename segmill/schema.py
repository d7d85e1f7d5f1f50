"""The fixed tables, and the constants that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REQUIRED = {"customer_id": "string", "order_id": "string", "order_date": "datetime", "order_value": "float"}
OPTIONAL = {"quantity": "int", "unit_price": "float", "product_category": "string", "customer_email": "string", "signup_date": "datetime", "support_tickets": "int"}
FIELDS = REQUIRED | OPTIONAL
SPARK_TYPES = {"string": T.StringType(), "datetime": T.TimestampNTZType(), "float": T.DoubleType(), "int": T.LongType()}
ORDER_LINE = T.StructType([T.StructField(name, SPARK_TYPES[kind], name not in REQUIRED) for name, kind in FIELDS.items()])
K_TABLE = T.StructType([T.StructField("k", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("avg_silhouette", "avg_davies_bouldin", "avg_stability_ari", "min_cluster_pct")], T.StructField("disqualified", T.BooleanType())])

#: Persona, what to do, where, priority and its weight.
ACTIONS = [
    ("Loyal Big Spenders", "Send early access to new products / VIP perks", "Email + SMS", "retain", 4),
    ("At-Risk High Value", "Win-back discount within 7 days", "Email", "urgent", 5),
    ("New Customers", "Onboarding email series + second-purchase incentive", "Email", "convert", 3),
    ("One-Time Buyers", "Light remarketing, low-cost nudge offer", "Retargeting ads", "monitor", 2),
    ("Low Engagement", "Remove from paid spend, keep on passive email only", "Passive email", "deprioritize", 1),
]
FALLBACK_PERSONA = "Low Engagement"
BANDS = ["very_low", "low", "mid", "high", "very_high"]
MARGIN = 0.30
AT_RISK = ["at risk", "at-risk", "dormant", "churn", "lapsed"]
K_RANGE, MIN_SHARE, SEEDS, MIN_ARI, SEED, STARTS = (2, 15), 0.03, 8, 0.7, 42, 10
CONFIDENT, MIN_REQUIRED, SAMPLES = 0.6, 2, 5


def actions(spark: SparkSession) -> DataFrame:
    """Five rows, small enough to broadcast at any scale."""
    return spark.createDataFrame(ACTIONS, "persona string, action string, channel string, priority string, priority_score int")
