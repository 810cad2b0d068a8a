"""The SQL reports of the serving store, each as SQL text and as a DataFrame.

Both forms read the same three typed tables: `recommendations`, `subscriber_360_profiles` and
`subscriber_monthly_arpu`. Means are exact sums divided by counts, so that they do not depend on
row order. `SQL[name]` runs with `run_sql`; `FRAMES[name]` takes the tables and keyword arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subpanel.functions.columns import n_rows
from subpanel.operators import serving


@dataclass(frozen=True)
class Store:
    recommendations: DataFrame
    profiles: DataFrame
    monthly: DataFrame

    def register(self) -> None:
        """Temporary views under the names the SQL texts use."""
        self.recommendations.createOrReplaceTempView("recommendations")
        self.profiles.createOrReplaceTempView("subscriber_360_profiles")
        self.monthly.createOrReplaceTempView("subscriber_monthly_arpu")


def _mean_sql(c: str) -> str:
    return f"CAST(SUM({c}) AS DOUBLE) / COUNT({c})"


def mean(c: str):
    """Mean of a DECIMAL column: exact sum, one division."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))

_BY_PRIORITY = "ORDER BY priority_score DESC NULLS LAST, isdn"

SQL: dict[str, str] = {
    "q01": "SELECT * FROM recommendations WHERE isdn = :isdn",
    "q02": """
        SELECT p.*, h.monthly_arpu
        FROM subscriber_360_profiles p
        LEFT JOIN (
            SELECT isdn, sort_array(collect_list(named_struct('month', data_month, 'arpu_call', arpu_call,
                   'arpu_sms', arpu_sms, 'arpu_data', arpu_data, 'arpu_total', arpu_total))) AS monthly_arpu
            FROM subscriber_monthly_arpu WHERE isdn = :isdn GROUP BY isdn) h ON h.isdn = p.isdn
        WHERE p.isdn = :isdn""",
    "q03": f"""
        SELECT isdn, subscriber_type, advance_amount, revenue_per_advance, customer_value_score,
               advance_readiness_score, priority_score
        FROM recommendations WHERE service_type = :service {_BY_PRIORITY} LIMIT 100""",
    "q04": f"""
        SELECT service_type, bad_debt_risk, COUNT(*) AS subscriber_count, SUM(advance_amount) AS total_advance,
               SUM(revenue_per_advance) AS total_revenue, {_mean_sql('customer_value_score')} AS avg_customer_value,
               {_mean_sql('advance_readiness_score')} AS avg_readiness
        FROM recommendations GROUP BY service_type, bad_debt_risk ORDER BY service_type, bad_debt_risk""",
    "q05": f"""
        SELECT service_type, bad_debt_risk, COUNT(*) AS subscriber_count, SUM(advance_amount) AS total_advance,
               SUM(revenue_per_advance) AS total_revenue_potential,
               {_mean_sql('customer_value_score')} AS avg_customer_value,
               {_mean_sql('advance_readiness_score')} AS avg_readiness
        FROM recommendations GROUP BY service_type, bad_debt_risk ORDER BY total_revenue_potential DESC""",
    "q06": f"""
        SELECT isdn, service_type, advance_amount, revenue_per_advance, customer_value_score, advance_readiness_score
        FROM recommendations
        WHERE bad_debt_risk = 'LOW' AND customer_value_score >= 70 AND advance_readiness_score >= 80
        {_BY_PRIORITY} LIMIT 1000""",
    "q07": f"""
        SELECT service_type, arpu_trend, COUNT(*) AS count, {_mean_sql('arpu_avg_6m')} AS avg_arpu,
               {_mean_sql('arpu_growth_rate')} AS avg_growth_rate
        FROM recommendations GROUP BY service_type, arpu_trend ORDER BY service_type, arpu_trend""",
    "q08": f"""
        SELECT user_type, COUNT(*) AS count, {_mean_sql('customer_value_score')} AS avg_value_score,
               {_mean_sql('revenue_call_pct')} AS avg_call_pct, {_mean_sql('revenue_sms_pct')} AS avg_sms_pct,
               {_mean_sql('revenue_data_pct')} AS avg_data_pct
        FROM recommendations WHERE user_type IS NOT NULL GROUP BY user_type ORDER BY count DESC""",
    "q09": f"""
        SELECT cluster_group, COUNT(*) AS subscriber_count, {_mean_sql('customer_value_score')} AS avg_value,
               {_mean_sql('arpu_avg_6m')} AS avg_arpu,
               COUNT(CASE WHEN bad_debt_risk = 'LOW' THEN 1 END) AS low_risk_count,
               COUNT(CASE WHEN bad_debt_risk = 'MEDIUM' THEN 1 END) AS medium_risk_count
        FROM recommendations GROUP BY cluster_group ORDER BY cluster_group""",
    "q10": """
        SELECT data_month, arpu_call, arpu_sms, arpu_data, arpu_total
        FROM subscriber_monthly_arpu WHERE isdn = :isdn ORDER BY data_month""",
    "q11": f"""
        SELECT data_month, {_mean_sql('arpu_total')} AS avg_arpu, COUNT(*) AS subscriber_count
        FROM subscriber_monthly_arpu GROUP BY data_month ORDER BY data_month""",
    "q12": f"""
        SELECT service_type, COUNT(*) AS total_count, SUM(advance_amount) AS total_advance,
               SUM(revenue_per_advance) AS total_revenue, {_mean_sql('customer_value_score')} AS avg_value_score
        FROM recommendations GROUP BY service_type""",
    "q13": f"""
        SELECT service_type, bad_debt_risk, COUNT(*) AS count, {_mean_sql('advance_amount')} AS avg_advance
        FROM recommendations GROUP BY service_type, bad_debt_risk ORDER BY service_type, bad_debt_risk""",
    "q14": f"""
        SELECT COUNT(*) AS total, SUM(advance_amount) AS total_advance, SUM(revenue_per_advance) AS total_revenue,
               {_mean_sql('customer_value_score')} AS avg_value
        FROM recommendations WHERE service_type = :service""",
    "q15": "SELECT service_type, COUNT(*) AS count FROM recommendations GROUP BY service_type",
    "q16": """
        SELECT r.* EXCEPT (updated_at),
               CASE WHEN c.isdn IS NOT NULL THEN CAST(:now AS TIMESTAMP) ELSE r.updated_at END AS updated_at
        FROM recommendations r
        LEFT JOIN (SELECT DISTINCT isdn FROM campaign_results WHERE accepted) c ON r.isdn = c.isdn""",
    "q17": """
        SELECT 'recommendations' AS table_name, COUNT(*) AS rows FROM recommendations
        UNION ALL SELECT 'subscriber_360_profiles', COUNT(*) FROM subscriber_360_profiles
        UNION ALL SELECT 'subscriber_monthly_arpu', COUNT(*) FROM subscriber_monthly_arpu""",
    "q18": "SELECT * FROM recommendations ORDER BY isdn LIMIT 5",
    "q19": """
        SELECT service_type, COUNT(*) AS count, SUM(advance_amount) AS total_advance
        FROM recommendations GROUP BY service_type""",
}


def run_sql(store: Store, name: str, **args) -> DataFrame:
    """Run a report's SQL text; `campaign_results` may be given as a DataFrame."""
    store.register()
    if isinstance(results := args.pop("campaign_results", None), DataFrame):
        results.createOrReplaceTempView("campaign_results")
    return store.recommendations.sparkSession.sql(SQL[name], args=args or None)


def _q02(s: Store, isdn: str) -> DataFrame:
    one = F.col("isdn") == isdn
    return serving.profile_with_history(s.profiles.filter(one), s.monthly.filter(one))


def _revenue(s: Store, total: str) -> DataFrame:
    return s.recommendations.groupBy("service_type", "bad_debt_risk").agg(
        n_rows().alias("subscriber_count"), F.sum("advance_amount").alias("total_advance"),
        F.sum("revenue_per_advance").alias(total), mean("customer_value_score").alias("avg_customer_value"),
        mean("advance_readiness_score").alias("avg_readiness"))


def _q07(s: Store) -> DataFrame:
    return (s.recommendations.groupBy("service_type", "arpu_trend")
            .agg(n_rows().alias("count"), mean("arpu_avg_6m").alias("avg_arpu"), mean("arpu_growth_rate").alias("avg_growth_rate"))
            .orderBy("service_type", "arpu_trend"))


def _q08(s: Store) -> DataFrame:
    return (s.recommendations.filter(F.col("user_type").isNotNull()).groupBy("user_type")
            .agg(n_rows().alias("count"), mean("customer_value_score").alias("avg_value_score"),
                 *[mean(f"revenue_{p}_pct").alias(f"avg_{p}_pct") for p in ("call", "sms", "data")])
            .orderBy(F.desc("count")))


def _q09(s: Store) -> DataFrame:
    return (s.recommendations.groupBy("cluster_group")
            .agg(n_rows().alias("subscriber_count"), mean("customer_value_score").alias("avg_value"),
                 mean("arpu_avg_6m").alias("avg_arpu"),
                 F.count_if(F.col("bad_debt_risk") == "LOW").alias("low_risk_count"),
                 F.count_if(F.col("bad_debt_risk") == "MEDIUM").alias("medium_risk_count"))
            .orderBy("cluster_group"))


def _q17(s: Store) -> DataFrame:
    one = lambda df, n: df.agg(n_rows().alias("rows")).select(F.lit(n).alias("table_name"), "rows")
    return (one(s.recommendations, "recommendations").unionByName(one(s.profiles, "subscriber_360_profiles"))
            .unionByName(one(s.monthly, "subscriber_monthly_arpu")))


FRAMES: Mapping[str, Callable[..., DataFrame]] = {
    "q01": lambda s, isdn: s.recommendations.filter(F.col("isdn") == isdn),
    "q02": _q02,
    "q03": lambda s, service: serving.top_by_priority(s.recommendations, service, 100).select(
        "isdn", "subscriber_type", "advance_amount", "revenue_per_advance", "customer_value_score",
        "advance_readiness_score", "priority_score"),
    "q04": lambda s: _revenue(s, "total_revenue").orderBy("service_type", "bad_debt_risk"),
    "q05": lambda s: _revenue(s, "total_revenue_potential").orderBy(F.desc("total_revenue_potential")),
    "q06": lambda s, n=1000: serving.high_value_low_risk(s.recommendations, n).select(
        "isdn", "service_type", "advance_amount", "revenue_per_advance", "customer_value_score",
        "advance_readiness_score"),
    "q07": _q07,
    "q08": _q08,
    "q09": _q09,
    "q10": lambda s, isdn: serving.history(s.monthly, isdn),
    "q11": lambda s: s.monthly.groupBy("data_month").agg(
        mean("arpu_total").alias("avg_arpu"), n_rows().alias("subscriber_count")).orderBy("data_month"),
    "q12": lambda s: s.recommendations.groupBy("service_type").agg(
        n_rows().alias("total_count"), F.sum("advance_amount").alias("total_advance"),
        F.sum("revenue_per_advance").alias("total_revenue"), mean("customer_value_score").alias("avg_value_score")),
    "q13": lambda s: s.recommendations.groupBy("service_type", "bad_debt_risk").agg(
        n_rows().alias("count"), mean("advance_amount").alias("avg_advance")).orderBy("service_type", "bad_debt_risk"),
    "q14": lambda s, service: s.recommendations.filter(F.col("service_type") == service).agg(
        n_rows().alias("total"), F.sum("advance_amount").alias("total_advance"),
        F.sum("revenue_per_advance").alias("total_revenue"), mean("customer_value_score").alias("avg_value")),
    "q15": lambda s: s.recommendations.groupBy("service_type").agg(n_rows().alias("count")),
    "q16": lambda s, campaign_results, now: serving.apply_campaign_results(s.recommendations, campaign_results, now),
    "q17": _q17,
    "q18": lambda s: s.recommendations.orderBy("isdn").limit(5),
    "q19": lambda s: s.recommendations.groupBy("service_type").agg(
        n_rows().alias("count"), F.sum("advance_amount").alias("total_advance")),
}
