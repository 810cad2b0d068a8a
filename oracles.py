"""The same results in DuckDB SQL over the test tables.

`CTES` holds one named step per stage; `oracle_queries` puts in front of each final query the steps
it needs.
"""

from __future__ import annotations

import re

MONTHS = ["202503", "202504", "202505", "202506", "202507", "202508"]
_MONTH_ROWS = ", ".join(f"('{m}')" for m in ["202502", *MONTHS])
_NOW, _LATER, _DAY = "TIMESTAMP '2025-08-31 00:00:00'", "TIMESTAMP '2025-09-05 00:00:00'", "DATE '2025-08-31'"


def _panel_month(c: str) -> str:
    return f"CAST(202503 + year({c}) - 1996 AS VARCHAR)"



def _mode(table: str, column: str) -> str:
    return f"""(SELECT isdn, data_month, {column} AS top_value FROM (
        SELECT isdn, data_month, {column}, row_number() OVER (PARTITION BY isdn, data_month
               ORDER BY count(*) DESC, {column}) AS rn
        FROM {table} WHERE {column} IS NOT NULL GROUP BY isdn, data_month, {column}) WHERE rn = 1)"""


def _rolling(column: str, months: int) -> str:
    return f"coalesce(sum({column}) OVER (w ROWS BETWEEN {months} PRECEDING AND 1 PRECEDING), 0)"


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def _delta(cond: str, value: int) -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE 0 END"


ARPU = ["arpu_call", "arpu_sms", "arpu_data", "arpu_total"]
CENTROID_COLUMNS = ["topup_count", "total_topup_amount", "num_packages", "burn_rate_capped"]
CENTROIDS = [(1.0, 1.0, 0.5, -0.5), (0.0, 0.0, 0.0, 0.0), (-1.0, -1.0, -0.5, 0.5)]
HOURS = "CASE WHEN {a} <= 5000 THEN 24 WHEN {a} <= 15000 THEN 36 WHEN {a} <= 30000 THEN 48 ELSE 60 END"
CLUSTER_FEATURES = [
    "topup_freq_none", "topup_freq_low", "topup_freq_medium", "topup_freq_high", "is_heavy_topup_user",
    "topup_amount_high", "avg_topup_high", "topup_cv", "topup_is_stable", "topup_count_last_1m",
    "topup_count_last_2m", "topup_count_last_3m", "topup_amount_last_1m", "topup_amount_last_2m",
    "topup_amount_last_3m", "estimated_balance", "balance_is_negative", "balance_is_low", "burn_rate_capped",
    "burn_rate_high", "burn_rate_very_high", "financial_stress_score", "is_active_user", "usage_intensity",
    "has_multiple_packages", "has_high_value_package", "package_per_topup_ratio", "num_renewed_packages",
    "avg_package_cycle"]

CTES: dict[str, str] = {
    "n10": f"""
        SELECT c_name AS isdn, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'POS' ELSE 'PRE' END AS subscriber_type,
               CASE WHEN c_nationkey % 5 = 0 THEN 'DEACT' ELSE 'ACTIF' END AS subscriber_status,
               c_mktsegment AS status_detail, DATE '2021-01-01' + CAST((c_custkey * 37) % 1700 AS INTEGER) AS activation_date,
               DATE '2021-01-01' + CAST((c_custkey * 37) % 1700 + 3650 AS INTEGER) AS expire_date, m.data_month
        FROM customer, (VALUES {_MONTH_ROWS}) m(data_month)""",
    "n5": f"""
        SELECT c_name AS isdn, {_panel_month('o_orderdate')} AS data_month,
               CAST(o_totalprice / 5 AS DECIMAL(18,4)) AS topup_amount, o_orderpriority AS topup_channel
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lines": f"""
        SELECT l.*, {_panel_month('l_shipdate')} AS data_month, o_custkey, c_name AS isdn
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "n4": """
        SELECT p.c_name AS isdn, data_month, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
               CASE l_returnflag WHEN 'A' THEN 'ut' WHEN 'R' THEN 'hu' ELSE 'oth' END AS source,
               CASE l_suppkey % 4 WHEN 0 THEN 'EasyCredit' WHEN 1 THEN 'ungdata247' WHEN 2 THEN 'MBFG' ELSE 'UT_SPLUS' END
               AS advance_service_type
        FROM lines JOIN customer p ON p.c_custkey = greatest(o_custkey - o_custkey % 3, 3)""",
    "n2": """
        SELECT isdn, data_month, p_brand AS package_code, CAST(p_retailprice * 30 AS DECIMAL(18,4)) AS package_price,
               CAST(p_size AS DECIMAL(18,4)) AS package_cycle, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS renewed_at
        FROM lines JOIN part ON l_partkey = p_partkey""",
    "n3": """
        SELECT c_name AS isdn, CAST(202503 + least(CAST(floor((day(ts) - 1) / 5.0) AS INTEGER), 5) AS VARCHAR) AS data_month, event_id
        FROM events JOIN customer ON user_id = c_custkey""",
    "n1": """
        SELECT isdn, data_month, sum(CASE WHEN l_returnflag = 'A' THEN v ELSE 0 END) AS arpu_call,
               sum(CASE WHEN l_returnflag = 'R' THEN v ELSE 0 END) AS arpu_sms,
               sum(CASE WHEN l_returnflag = 'N' THEN v ELSE 0 END) AS arpu_data, sum(v) AS arpu_total
        FROM (SELECT *, CAST(l_quantity * l_discount * 1000 * CASE WHEN o_custkey % 7 = 0 THEN 12 ELSE 1 END
                             AS DECIMAL(18,4)) AS v FROM lines)
        GROUP BY isdn, data_month, l_orderkey""",
    "arpu": "SELECT isdn, data_month, " + ", ".join(f"CAST(sum({c}) AS DOUBLE) / count(*) AS {c}" for c in ARPU)
            + " FROM n1 GROUP BY isdn, data_month",
    "adv": f"""
        WITH split AS (
            SELECT isdn, data_month, advance_service_type,
                   CASE WHEN advance_service_type IN ('EasyCredit', 'ungdata247') THEN CAST(amount / 10 AS DECIMAL(18,4))
                        ELSE amount END AS fixed, source FROM n4),
        sums AS (
            SELECT isdn, data_month, count(*) AS advance_count,
                   CAST(sum(CASE WHEN source = 'ut' THEN fixed ELSE 0 END) AS DOUBLE) AS total_advance_amount,
                   CAST(max(CASE WHEN source = 'ut' THEN fixed ELSE 0 END) AS DOUBLE) AS max_advance_amount,
                   CAST(sum(CASE WHEN source = 'hu' THEN fixed ELSE 0 END) AS DOUBLE) AS total_repayment_amount
            FROM split GROUP BY isdn, data_month)
        SELECT s.*, coalesce(m.top_value, 'Unknown') AS most_used_advance_service,
               total_advance_amount / advance_count AS avg_advance_amount,
               CASE WHEN total_advance_amount > 0 THEN total_repayment_amount / total_advance_amount ELSE 0.0 END AS avg_repayment_rate,
               greatest(total_advance_amount - total_repayment_amount, 0) AS outstanding_debt, true AS has_advance_in_month
        FROM sums s LEFT JOIN {_mode('n4', 'advance_service_type')} m USING (isdn, data_month)""",
    "top": f"""
        WITH sums AS (
            SELECT isdn, data_month, count(*) AS topup_count, CAST(sum(topup_amount) AS DOUBLE) AS total_topup_amount,
                   coalesce(stddev_samp(CAST(topup_amount AS DOUBLE)), 0) AS std_topup_amount,
                   CAST(max(topup_amount) AS DOUBLE) AS max_topup_amount
            FROM n5 GROUP BY isdn, data_month)
        SELECT s.*, total_topup_amount / topup_count AS avg_topup_amount,
               coalesce(m.top_value, 'Unknown') AS most_used_topup_channel
        FROM sums s LEFT JOIN {_mode('n5', 'topup_channel')} m USING (isdn, data_month)""",
    "pkg": """
        SELECT isdn, data_month, count(package_code) AS num_packages, CAST(sum(package_price) AS DOUBLE) AS total_package_value,
               CAST(sum(package_price) AS DOUBLE) / count(*) AS avg_package_price,
               CAST(max(package_price) AS DOUBLE) AS max_package_price,
               CAST(sum(package_cycle) AS DOUBLE) / count(*) AS avg_package_cycle,
               count(*) AS num_active_packages, count(renewed_at) AS num_renewed_packages
        FROM n2 GROUP BY isdn, data_month""",
    "usg": "SELECT isdn, data_month, count(*) AS n3_record_count FROM n3 GROUP BY isdn, data_month",
    "master": "SELECT isdn, subscriber_type, subscriber_status, status_detail, activation_date, expire_date, data_month, "
              + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ARPU + [
                  "advance_count", "total_advance_amount", "avg_advance_amount", "max_advance_amount", "total_repayment_amount",
                  "avg_repayment_rate", "outstanding_debt", "topup_count", "total_topup_amount", "avg_topup_amount",
                  "std_topup_amount", "max_topup_amount", "num_packages", "total_package_value", "avg_package_price",
                  "max_package_price", "avg_package_cycle", "num_active_packages", "num_renewed_packages", "n3_record_count"])
              + """, coalesce(has_advance_in_month, false) AS has_advance_in_month,
               coalesce(most_used_advance_service, 'Unknown') AS most_used_advance_service,
               coalesce(most_used_topup_channel, 'Unknown') AS most_used_topup_channel
        FROM n10 LEFT JOIN arpu USING (isdn, data_month) LEFT JOIN adv USING (isdn, data_month)
        LEFT JOIN top USING (isdn, data_month) LEFT JOIN pkg USING (isdn, data_month) LEFT JOIN usg USING (isdn, data_month)""",
    "q": """
        SELECT quantile_cont(topup_count, 0.75) AS topup_count_q75, quantile_cont(total_topup_amount, 0.75) AS total_topup_amount_q75,
               quantile_cont(avg_topup_amount, 0.75) AS avg_topup_amount_q75,
               quantile_cont(total_package_value, 0.75) AS total_package_value_q75,
               quantile_cont(total_package_value, 0.9) AS total_package_value_q90 FROM master""",
    "feat1": "SELECT m.*, "
             + ", ".join(f"CAST({_rolling('advance_count', w)} AS BIGINT) AS advance_count_last_{w}m" for w in (1, 2, 3)) + ", "
             + ", ".join(f"CAST({_rolling('topup_count', w)} AS BIGINT) AS topup_count_last_{w}m" for w in (1, 2, 3)) + ", "
             + ", ".join(f"CAST({_rolling('CAST(total_topup_amount AS DECIMAL(28,4))', w)} AS DOUBLE) AS topup_amount_last_{w}m"
                         for w in (1, 2, 3))
             + f""", {_flag("sum(advance_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0")} AS has_advance_history,
               CAST(coalesce(CAST(data_month AS INTEGER) - max(CASE WHEN advance_count > 0 THEN CAST(data_month AS INTEGER) END)
                    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99) AS INTEGER) AS months_since_last_advance,
               {_flag('avg_repayment_rate >= 0.95')} AS is_good_payer, {_flag('outstanding_debt > 0')} AS has_outstanding_debt,
               {_flag('advance_count > 1')} AS is_repeat_advancer, {_flag('topup_count = 0')} AS topup_freq_none,
               {_flag('topup_count > 0 AND topup_count <= 2')} AS topup_freq_low,
               {_flag('topup_count > 2 AND topup_count <= 5')} AS topup_freq_medium, {_flag('topup_count > 5')} AS topup_freq_high,
               {_flag('topup_count > topup_count_q75')} AS is_heavy_topup_user,
               {_flag('total_topup_amount > total_topup_amount_q75')} AS topup_amount_high,
               {_flag('avg_topup_amount > avg_topup_amount_q75')} AS avg_topup_high,
               CASE WHEN avg_topup_amount > 0 THEN std_topup_amount / avg_topup_amount ELSE 0.0 END AS topup_cv,
               total_topup_amount - total_package_value AS estimated_balance,
               CASE WHEN total_topup_amount > 0 THEN total_package_value / total_topup_amount ELSE 999.0 END AS burn_rate,
               {_flag('n3_record_count > 0')} AS is_active_user, n3_record_count AS usage_intensity,
               {_flag('num_packages > 1')} AS has_multiple_packages,
               {_flag('total_package_value > total_package_value_q75')} AS has_high_value_package,
               {_flag('total_package_value > total_package_value_q90')} AS _top_package,
               CASE WHEN topup_count > 0 THEN num_packages / topup_count ELSE 0.0 END AS package_per_topup_ratio,
               {_flag("subscriber_type = 'PRE'")} AS is_prepaid, {_flag("subscriber_status = 'ACTIF'")} AS is_active_status,
               CAST(greatest(DATE '2025-08-01' - activation_date, 0) AS INTEGER) AS subscriber_tenure_days
        FROM master m, q WINDOW w AS (PARTITION BY isdn ORDER BY data_month)""",
    "feat": f"""
        SELECT *, {_flag('topup_cv < 0.5')} AS topup_is_stable, {_flag('estimated_balance < 0')} AS balance_is_negative,
               {_flag('estimated_balance < 50000')} AS balance_is_low, least(burn_rate, 5.0) AS burn_rate_capped,
               {_flag('burn_rate > 1.0')} AS burn_rate_high, {_flag('burn_rate > 1.5')} AS burn_rate_very_high,
               {_flag('subscriber_tenure_days < 90')} AS is_new_subscriber, {_flag('subscriber_tenure_days > 365')} AS is_mature_subscriber,
               is_heavy_topup_user * is_good_payer AS heavy_user_good_payer,
               is_heavy_topup_user * has_outstanding_debt AS heavy_user_has_debt,
               topup_amount_high * has_high_value_package AS high_topup_high_package,
               is_repeat_advancer * is_good_payer AS repeat_advance_good_payer,
               {_flag('estimated_balance < 0')} + {_flag('burn_rate > 1.0')} + has_outstanding_debt + topup_freq_none + _top_package
               AS financial_stress_score
        FROM feat1""",
    "advu": "SELECT DISTINCT isdn FROM feat WHERE has_advance_in_month",
    "snap": """SELECT f.*, advu.isdn IS NOT NULL AS is_advance_user FROM feat f LEFT JOIN advu ON f.isdn = advu.isdn
               WHERE f.data_month = '202508'""",
    "std": "SELECT isdn, " + ", ".join(
        f"coalesce((s.{c} - m.{c}_mean) / nullif(m.{c}_std, 0), 0) AS {c}" for c in CENTROID_COLUMNS)
           + " FROM snap s, (SELECT " + ", ".join(
        f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in CENTROID_COLUMNS) + " FROM snap) m",
    "clus": "SELECT isdn, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM (SELECT isdn, "
            + ", ".join(" + ".join(f"({c} - ({v}))::DOUBLE * ({c} - ({v}))" for c, v in zip(CENTROID_COLUMNS, centre)) + f" AS d{i}"
                        for i, centre in enumerate(CENTROIDS)) + " FROM std)",
    "seg0": "SELECT snap.*, cluster FROM snap JOIN clus USING (isdn)",
    "ranks": """SELECT cluster, row_number() OVER (ORDER BY avg(CAST(is_advance_user AS INTEGER)) DESC, cluster) - 1 AS rank,
                count(*) OVER () AS k FROM seg0 GROUP BY cluster""",
    "seg": """SELECT s.*, CASE WHEN is_advance_user THEN 'GROUP_1_EXISTING' WHEN rank = 0 THEN 'GROUP_2_SIMILAR'
                     WHEN rank = k - 1 THEN 'GROUP_3_UNLIKELY' ELSE 'GROUP_2_MEDIUM' END AS segment
              FROM seg0 s JOIN ranks USING (cluster)""",
}


def _offers(source: str) -> str:
    """Offer rules over the rows of `source` (prepaid, latest month)."""
    return f"""
        WITH s AS (
            SELECT *, arpu_total AS arpu, CASE WHEN arpu_total > 0 THEN (arpu_call + arpu_sms) / arpu_total * 100 ELSE 0.0 END AS voice_sms_pct
            FROM {source} WHERE subscriber_type = 'PRE'),
        r AS (
            SELECT *, CASE WHEN voice_sms_pct > 70 THEN 1
                WHEN topup_count_last_1m >= 1 AND (topup_amount_last_1m >= 50000 OR avg_topup_amount >= 50000)
                     AND topup_count_last_2m >= 1 THEN 2
                WHEN topup_count_last_1m >= 2 THEN 3 ELSE 4 END AS rule FROM s),
        a AS (
            SELECT *, CAST(CASE rule WHEN 1 THEN round_even(CAST(least(greatest(arpu * 0.8::DOUBLE, 10000), 50000) AS DOUBLE) / 1000, 0) * 1000
                WHEN 2 THEN CASE WHEN arpu > 100000 THEN 50000 ELSE 25000 END
                WHEN 3 THEN least(greatest(round_even(CAST(arpu * 1.2::DOUBLE AS DOUBLE) / 1000, 0) * 1000, 10000), 50000)
                ELSE 10000 END AS DOUBLE) AS advance_amount FROM r)
        SELECT isdn, subscriber_type, CASE rule WHEN 1 THEN 'ungsanluong' WHEN 2 THEN 'EasyCredit' ELSE 'MBFG' END AS service_type,
               advance_amount,
               CASE rule WHEN 1 THEN {HOURS.format(a='advance_amount')} WHEN 2 THEN -1
                    WHEN 3 THEN {HOURS.format(a='advance_amount')} ELSE 24 END AS usage_time_hours,
               CASE rule WHEN 1 THEN advance_amount * 0.2::DOUBLE WHEN 2 THEN advance_amount * 0.3::DOUBLE
                    WHEN 3 THEN advance_amount * 0.3::DOUBLE ELSE 3000 END AS revenue_per_advance,
               arpu, arpu_call, arpu_sms, arpu_data, voice_sms_pct, topup_count_last_1m, topup_amount_last_1m, avg_topup_amount,
               CASE rule WHEN 1 THEN 'voice_sms_pct > 70%' WHEN 2 THEN 'topup >= 50k/month, consistent 2 months'
                    WHEN 3 THEN 'topup >= 2 times/month, amount < 50k' ELSE 'fallback - default to MBFG 10k' END AS classification_reason
        FROM a"""


_FREE = "service_type = 'MBFG'"


def _scored(source: str) -> str:
    deltas = [("topup_amount_last_1m >= advance_amount", -40),
              ("topup_amount_last_1m > 0 AND topup_amount_last_1m < advance_amount", -10), ("topup_amount_last_1m = 0", 40),
              (f"{_FREE} AND topup_amount_last_1m = 0", -20),
              ("topup_count_last_1m >= 3", -15), ("topup_count_last_1m = 2", -10), ("topup_count_last_1m = 1", -5),
              ("topup_count_last_1m = 0", 20),
              ("arpu >= 5000", -15), ("arpu >= 2000 AND arpu < 5000", -10), ("arpu >= 1000 AND arpu < 2000", -5), ("arpu < 500", 10),
              (f"{_FREE} AND arpu >= 2000", -10),
              ("avg_topup_amount >= 100000", -15), ("avg_topup_amount >= 50000 AND avg_topup_amount < 100000", -10),
              ("avg_topup_amount >= 20000 AND avg_topup_amount < 50000", -5), ("avg_topup_amount > 0 AND avg_topup_amount < 10000", 5),
              (f"{_FREE} AND avg_topup_amount >= 20000", -10)]
    return f"""
        SELECT *, CASE WHEN risk_score <= 30 THEN 'LOW' WHEN risk_score <= 60 THEN 'MEDIUM' ELSE 'HIGH' END AS bad_debt_risk
        FROM (SELECT *, 50 + {" + ".join(_delta(c, v) for c, v in deltas)} AS risk_score,
                     CASE WHEN advance_amount > 0 THEN topup_amount_last_1m / advance_amount ELSE 0.0 END AS topup_advance_ratio
              FROM {source})"""


def _share(c: str) -> str:
    return f"CASE WHEN arpu > 0 THEN {c} / arpu * 100 ELSE 0.0 END"


def _dec(c: str, p: int, s: int, name: str | None = None) -> str:
    # Seven places first: floating-point noise must not decide a half.
    return f"CAST(CAST({c} AS DECIMAL(28,7)) AS DECIMAL({p},{s})) AS {name or c}"


PROFILE_COLUMNS = [
    "isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance", "arpu", "arpu_call", "arpu_sms", "arpu_data",
    "arpu_avg_6m", "arpu_std_6m", "arpu_min_6m", "arpu_max_6m", "arpu_growth_rate", "arpu_trend", "revenue_call_pct",
    "revenue_sms_pct", "revenue_data_pct", "voice_sms_pct", "user_type", "topup_count_last_1m", "topup_amount_last_1m",
    "avg_topup_amount", "topup_frequency", "topup_advance_ratio", "bad_debt_risk", "risk_score", "customer_value_score",
    "advance_readiness_score", "classification_reason", "months_count", "arpu_first_month", "arpu_last_month",
    "topup_frequency_class", "topup_avg_amount", "topup_min_amount", "topup_max_amount", "cluster_group"]

_SERVING_MEASURES = ",\n               ".join(
    [_dec(c, 12, 2) for c in ("advance_amount", "revenue_per_advance")]
    + [_dec(c, 10, 2) for c in ("arpu_avg_6m", "arpu_std_6m", "arpu_min_6m", "arpu_max_6m", "arpu_growth_rate")]
    + [_dec(c, 5, 2) for c in ("revenue_call_pct", "revenue_sms_pct", "revenue_data_pct")]
    + [_dec("topup_count_last_1m", 5, 2, "topup_frequency"), _dec("topup_avg_amount", 10, 2),
       _dec("topup_advance_ratio", 10, 4), _dec("customer_value_score", 5, 2), _dec("advance_readiness_score", 5, 2)])

CTES |= {
    "recs": _offers("(SELECT * FROM snap WHERE NOT is_advance_user)"),
    "scored": _scored("recs"),
    "final": "SELECT * FROM scored WHERE bad_debt_risk IN ('LOW', 'MEDIUM')",
    "monthly": "SELECT isdn, data_month, " + ", ".join(ARPU) + " FROM master WHERE isdn IN (SELECT isdn FROM final)",
    "stats": """
        SELECT *, CASE WHEN arpu_growth_rate > 10 THEN 'Tăng trưởng' WHEN arpu_growth_rate < -10 THEN 'Giảm' ELSE 'Ổn định' END AS arpu_trend
        FROM (SELECT *, CASE WHEN arpu_first > 0 THEN (arpu_last - arpu_first) / arpu_first * 100 ELSE 0.0 END AS arpu_growth_rate
              FROM (SELECT isdn, CAST(sum(CAST(arpu_total AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS arpu_avg_6m, stddev_samp(arpu_total) AS arpu_std_6m, min(arpu_total) AS arpu_min_6m,
                           max(arpu_total) AS arpu_max_6m, arg_min(arpu_total, data_month) AS arpu_first,
                           arg_max(arpu_total, data_month) AS arpu_last, avg(arpu_call) AS arpu_call_avg,
                           avg(arpu_sms) AS arpu_sms_avg, avg(arpu_data) AS arpu_data_avg, count(data_month) AS months_count
                    FROM monthly GROUP BY isdn))""",
    "prof": f"""
        WITH j AS (
            SELECT f.*, s.* EXCLUDE (isdn), t.* EXCLUDE (isdn), c.cluster AS cluster_group,
                   {_share('arpu_call')} AS revenue_call_pct, {_share('arpu_sms')} AS revenue_sms_pct, {_share('arpu_data')} AS revenue_data_pct,
                   CASE WHEN topup_count_last_1m >= 4 THEN 'Thường xuyên' WHEN topup_count_last_1m >= 2 THEN 'Trung bình'
                        WHEN topup_count_last_1m >= 1 THEN 'Hiếm' ELSE 'Không nạp' END AS topup_frequency
            FROM final f LEFT JOIN stats s ON f.isdn = s.isdn LEFT JOIN clus c ON f.isdn = c.isdn
            LEFT JOIN (SELECT isdn, min(total_topup_amount) AS topup_min_amount, max(total_topup_amount) AS topup_max_amount
                       FROM master GROUP BY isdn) t ON f.isdn = t.isdn),
        k AS (
            SELECT *, CASE WHEN revenue_data_pct > 80 THEN 'Heavy Data User' WHEN revenue_data_pct < 20 THEN 'Voice/SMS User'
                           ELSE 'Balanced User' END AS user_type,
                   round_even(CAST(least(greatest(coalesce(arpu_avg_6m, arpu) / 50, 0), 40) AS DOUBLE)
                              + CAST(least(greatest(topup_advance_ratio * 10, 0), 30) AS DOUBLE)
                              + CAST(least(greatest((coalesce(arpu_growth_rate, 0) + 10) / 2, 0), 30) AS DOUBLE), 0) AS customer_value_score,
                   round_even(CAST(CASE bad_debt_risk WHEN 'LOW' THEN 50 WHEN 'MEDIUM' THEN 30 ELSE 0 END AS DOUBLE)
                              + CAST(least(greatest(topup_advance_ratio * 7.5::DOUBLE, 0), 30) AS DOUBLE)
                              + CASE topup_frequency WHEN 'Thường xuyên' THEN 20 WHEN 'Trung bình' THEN 10 WHEN 'Hiếm' THEN 5 ELSE 0 END, 0)
                   AS advance_readiness_score,
                   arpu_first AS arpu_first_month, arpu_last AS arpu_last_month, topup_frequency AS topup_frequency_class,
                   avg_topup_amount AS topup_avg_amount FROM j)
        SELECT {', '.join(PROFILE_COLUMNS)} FROM k""",
    "rec": f"""
        SELECT isdn, subscriber_type,
               CASE service_type WHEN 'EasyCredit' THEN 'Fee' WHEN 'MBFG' THEN 'Free' WHEN 'ungsanluong' THEN 'Quota' END AS service_type,
               cluster_group, bad_debt_risk, arpu_trend, user_type, topup_frequency_class,
               {_SERVING_MEASURES}, {_dec('customer_value_score * advance_readiness_score / 100', 10, 2, 'priority_score')},
               {_DAY} AS recommendation_date, {_NOW} AS updated_at FROM prof""",
    "sprof": f"""
        SELECT isdn, subscriber_type, service_type, cluster_group, bad_debt_risk, arpu_trend, user_type, topup_frequency_class,
               {_SERVING_MEASURES}, {_dec('arpu_first_month', 10, 2)}, {_dec('arpu_last_month', 10, 2)},
               {_dec('topup_min_amount', 10, 2)}, {_dec('topup_max_amount', 10, 2)}, {_dec('risk_score', 5, 2)},
               {_dec('revenue_per_advance', 12, 2, 'revenue_potential')},
               'Classified as ' || user_type || ' based on revenue breakdown' AS classification_reason,
               '[' || concat_ws(',', CASE WHEN arpu_avg_6m > 2000 THEN '"ARPU ổn định"' END,
                    CASE WHEN topup_frequency = 'Thường xuyên' THEN '"Topup thường xuyên"' END,
                    CASE WHEN topup_advance_ratio >= 3 THEN '"Tỷ lệ topup/ứng cao"' END,
                    CASE WHEN bad_debt_risk = 'LOW' THEN '"Rủi ro thấp"' END) || ']' AS strengths,
               {_DAY} AS profile_date, {_NOW} AS updated_at FROM prof""",
    "smon": "SELECT isdn, data_month, " + ", ".join(_dec(c, 10, 2) for c in ARPU) + " FROM monthly",
    "best": "SELECT isdn FROM rec ORDER BY priority_score DESC, isdn LIMIT 1",
    "sidx": """SELECT service_type, isdn, CAST(priority_score AS DOUBLE) AS score,
               row_number() OVER (PARTITION BY service_type ORDER BY priority_score DESC, isdn DESC) - 1 AS rank FROM rec""",
    "recstats": f"""
        SELECT CASE WHEN grouping(service_type) = 0 THEN 'service' WHEN grouping(bad_debt_risk) = 0 THEN 'risk'
                    WHEN grouping(cluster_group) = 0 THEN 'cluster' ELSE 'date' END AS dimension_type,
               coalesce(service_type, bad_debt_risk, CAST(cluster_group AS VARCHAR), CAST(recommendation_date AS VARCHAR)) AS dimension_value,
               CAST(count(*) AS INTEGER) AS total_count, CAST(sum(advance_amount) AS DOUBLE) AS total_advance_amount,
               CAST(sum(revenue_per_advance) AS DOUBLE) AS total_revenue_potential,
               CAST(CAST(CAST(sum(customer_value_score) AS DOUBLE) / count(*) AS DECIMAL(5,2)) AS DOUBLE) AS avg_customer_value_score,
               CAST(CAST(CAST(sum(advance_readiness_score) AS DOUBLE) / count(*) AS DECIMAL(5,2)) AS DOUBLE) AS avg_advance_readiness_score,
               {_DAY} AS stats_date
        FROM rec GROUP BY GROUPING SETS ((service_type), (bad_debt_risk), (cluster_group), (recommendation_date))""",
    "monthcounts": " UNION ALL ".join(
        f"SELECT '{n.upper()}' AS source, data_month, count(*) AS rows FROM {n} GROUP BY data_month"
        for n in ("n10", "n1", "n2", "n3", "n4", "n5")),
    "campaign": "SELECT c_name AS isdn, c_acctbal > 4000 AS accepted FROM customer",
}

_MATERIALIZED = {"lines", "master", "feat", "snap", "std", "seg", "scored", "prof", "rec", "monthly"}


def _needs(sql: str) -> list[str]:
    """Steps a text refers to, in order of definition."""
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in CTES if n in words]


def with_steps(sql: str) -> str:
    wanted: set[str] = set()
    open_steps = _needs(sql)
    while open_steps:
        name = open_steps.pop()
        if name not in wanted:
            wanted.add(name)
            open_steps += [n for n in _needs(CTES[name]) if n != name]
    steps = [f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({CTES[n].strip()})" for n in CTES if n in wanted]
    sql = sql.strip()
    if not steps:
        return sql
    # A query with steps of its own continues the list.
    rest = f", {sql[len('WITH '):]}" if sql.startswith("WITH ") else f" {sql}"
    return f"WITH {', '.join(steps)}{rest}"


def _mix(source: str, key: str, averages: dict[str, str], digits: dict[str, int] | None = None) -> str:
    digits = digits or {}
    cols = ", ".join(f"round(avg({c}), {digits[n]}) AS {n}" if n in digits else f"sum({c})::DOUBLE / count({c}) AS {n}"
                     for n, c in averages.items())
    return f"SELECT {key}, count(*) AS count, {cols}, count(*) / sum(count(*)) OVER ()::DOUBLE * 100 AS pct FROM {source} GROUP BY {key}"


def _mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / count({c})"


def _sum(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE)"


def _hist(edges: list[int], labels: list[str]) -> str:
    cases = " ".join(f"WHEN advance_amount > {lo} AND advance_amount <= {hi} THEN '{label}'"
                     for lo, hi, label in zip(edges, edges[1:], labels))
    return f"""SELECT bin, count(*) AS count, count(*) / (SELECT count(*) FROM scored) * 100 AS pct
               FROM (SELECT CASE {cases} END AS bin FROM scored) WHERE bin IS NOT NULL GROUP BY bin"""


def _rate(key: str) -> str:
    return f"""SELECT {key}, count(*) AS total, count(*) FILTER (is_advance_user) AS advance_users,
               round_even(CAST(count(*) FILTER (is_advance_user) / count(*) * 100 AS DOUBLE), 2) AS advance_rate,
               count(*) / (SELECT count(*) FROM seg) * 100 AS share_pct FROM seg GROUP BY {key}"""


def _feature_query(columns: list[str], noisy: tuple[str, ...] = ()) -> str:
    cols = [f"round({c}, 6) AS {c}" if c in noisy else c for c in columns]
    return f"SELECT isdn, data_month, {', '.join(cols)} FROM feat"


_OFFER_TOTALS = """SELECT count(*) AS {n}, sum(advance_amount) AS total_advance_amount, sum(revenue_per_advance) AS total_expected_revenue,
                   sum(advance_amount) / count(*) AS avg_advance_amount FROM {t}"""
_BY_SERVICE = """SELECT service_type, count(*) AS subscribers, sum(advance_amount) AS total_advance,
                 sum(revenue_per_advance) AS total_revenue FROM {t} GROUP BY service_type"""
_SHORT = "isdn, service_type, bad_debt_risk, CAST(priority_score AS DOUBLE) AS priority_score"
_REVENUE = f"""SELECT service_type, bad_debt_risk, count(*) AS subscriber_count, {_sum('advance_amount')} AS total_advance,
               {_sum('revenue_per_advance')} AS {{total}}, {_mean('customer_value_score')} AS avg_customer_value,
               {_mean('advance_readiness_score')} AS avg_readiness FROM rec GROUP BY service_type, bad_debt_risk"""

_MASTER_NAMES = [
    "isdn", "subscriber_type", "subscriber_status", "status_detail", "activation_date", "expire_date", "data_month", *ARPU,
    "advance_count", "total_advance_amount", "avg_advance_amount", "max_advance_amount", "total_repayment_amount",
    "most_used_advance_service", "avg_repayment_rate", "outstanding_debt", "has_advance_in_month", "topup_count",
    "total_topup_amount", "avg_topup_amount", "max_topup_amount", "most_used_topup_channel", "num_packages",
    "total_package_value", "avg_package_price", "max_package_price", "avg_package_cycle", "num_active_packages",
    "num_renewed_packages", "n3_record_count"]
_FEATURE_TABLE = (
    "status_detail,activation_date,expire_date,arpu_call,arpu_sms,arpu_data,arpu_total,advance_count,total_advance_amount,"
    "avg_advance_amount,max_advance_amount,total_repayment_amount,most_used_advance_service,avg_repayment_rate,outstanding_debt,"
    "has_advance_in_month,topup_count,total_topup_amount,avg_topup_amount,std_topup_amount,max_topup_amount,"
    "most_used_topup_channel,num_packages,total_package_value,avg_package_price,max_package_price,avg_package_cycle,"
    "num_active_packages,num_renewed_packages,n3_record_count,advance_count_last_1m,advance_count_last_2m,advance_count_last_3m,"
    "has_advance_history,months_since_last_advance,is_good_payer,has_outstanding_debt,is_repeat_advancer,topup_freq_none,"
    "topup_freq_low,topup_freq_medium,topup_freq_high,is_heavy_topup_user,topup_amount_high,avg_topup_high,topup_cv,"
    "topup_is_stable,topup_count_last_1m,topup_count_last_2m,topup_count_last_3m,topup_amount_last_1m,topup_amount_last_2m,"
    "topup_amount_last_3m,estimated_balance,balance_is_negative,balance_is_low,burn_rate,burn_rate_capped,burn_rate_high,"
    "burn_rate_very_high,financial_stress_score,is_active_user,usage_intensity,has_multiple_packages,has_high_value_package,"
    "package_per_topup_ratio,is_prepaid,is_active_status,subscriber_tenure_days,is_new_subscriber,is_mature_subscriber,"
    "heavy_user_good_payer,heavy_user_has_debt,high_topup_high_package,repeat_advance_good_payer").split(",")


def _family(*words: str) -> list[str]:
    return [c for c in _FEATURE_TABLE if any(w in c for w in words)]


_FAMILIES = {"advance": _family("advance"), "topup": _family("topup"), "financial": _family("balance", "burn", "arpu")}
_DOC_FIELDS = ["isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance", "cluster_group", "bad_debt_risk",
               "arpu_avg_6m", "arpu_growth_rate", "arpu_trend", "customer_value_score", "advance_readiness_score", "priority_score",
               "user_type", "topup_frequency_class", "updated_at"]
_DOC_ROWS = " UNION ALL ".join(
    f"SELECT 'rec:' || isdn AS key, '{f}' AS field, CAST({f} AS VARCHAR) AS value, {_NOW} + INTERVAL 7 DAY AS expires_at FROM rec"
    for f in _DOC_FIELDS)
_META = {"total_subscribers": "count(*)", "total_fee": "count(*) FILTER (service_type = 'Fee')",
         "total_free": "count(*) FILTER (service_type = 'Free')", "total_quota": "count(*) FILTER (service_type = 'Quota')",
         "total_low_risk": "count(*) FILTER (bad_debt_risk = 'LOW')", "total_medium_risk": "count(*) FILTER (bad_debt_risk = 'MEDIUM')",
         "avg_advance_amount": "round_even(sum(advance_amount)::DOUBLE / count(*), 2)",
         "total_revenue_potential": "round_even(sum(revenue_per_advance)::DOUBLE, 2)",
         "last_updated": f"max({_NOW})", "data_version": "max('v1.0')"}
_CHECKS = ([f"SELECT 'recommendations.{c} in domain' AS check_name, count(*) FILTER ({c} NOT IN ({v})) AS violations FROM rec"
            for c, v in (("subscriber_type", "'PRE', 'POS'"), ("service_type", "'Fee', 'Free', 'Quota'"),
                         ("bad_debt_risk", "'LOW', 'MEDIUM', 'HIGH'"))]
           + [f"SELECT '{t}.{c} not null', count(*) FILTER ({c} IS NULL) FROM {s}" for t, s, cols in (
               ("recommendations", "rec", ("isdn", "subscriber_type", "service_type", "advance_amount", "revenue_per_advance",
                                           "bad_debt_risk", "recommendation_date")),
               ("profiles", "sprof", ("isdn", "subscriber_type", "profile_date")), ("monthly", "smon", ("isdn", "data_month")))
              for c in cols]
           + [f"SELECT '{t}.{'+'.join(k)} unique', count(*) FROM (SELECT 1 FROM {s} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
              for t, s, k in (("recommendations", "rec", ["isdn"]), ("profiles", "sprof", ["isdn"]),
                              ("monthly", "smon", ["isdn", "data_month"]),
                              ("stats", "recstats", ["dimension_type", "dimension_value", "stats_date"]))]
           + ["SELECT 'profiles -> recommendations', count(*) FROM sprof WHERE isdn NOT IN (SELECT isdn FROM rec)"])
_SERVING_DOUBLES = ["advance_amount", "revenue_per_advance", "arpu_avg_6m", "arpu_std_6m", "arpu_min_6m", "arpu_max_6m",
                    "arpu_growth_rate", "revenue_call_pct", "revenue_sms_pct", "revenue_data_pct", "topup_frequency",
                    "topup_avg_amount", "topup_advance_ratio", "customer_value_score", "advance_readiness_score"]
_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SERVING_DOUBLES)
_HISTORY = "row_number() OVER (PARTITION BY isdn ORDER BY data_month) - 1"

FINAL: dict[str, str] = {
    "topup_monthly": "SELECT * REPLACE (round(std_topup_amount, 4) AS std_topup_amount) FROM top",
    "advance_monthly": "SELECT * FROM adv",
    "package_monthly": "SELECT * FROM pkg",
    "usage_monthly": "SELECT * FROM usg",
    "arpu_monthly": "SELECT * FROM arpu",
    "subscriber_months": "SELECT * FROM n10",
    "panel_coverage": """
        SELECT 'customer' AS source_table, count(*) AS rows_read FROM customer
        UNION ALL SELECT 'lineitem_packages', count(*) FROM lineitem UNION ALL SELECT 'lineitem_advances', count(*) FROM lineitem
        UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders""",
    "advance_source_counts": """SELECT count(*) FILTER (source = 'ut') AS advance_records,
        count(*) FILTER (source = 'hu') AS repayment_records, count(DISTINCT isdn) AS subscribers FROM n4""",
    "master": f"SELECT {', '.join(_MASTER_NAMES)}, round(std_topup_amount, 4) AS std_topup_amount FROM master",
    "phase1_summary": """SELECT count(*) AS total_records, count(DISTINCT isdn) AS unique_subscribers,
        (SELECT string_agg(data_month, ',' ORDER BY data_month) FROM (SELECT DISTINCT data_month FROM master)) AS months,
        count(DISTINCT isdn) FILTER (has_advance_in_month) AS advance_users, count(DISTINCT isdn) FILTER (topup_count > 0) AS topup_users,
        round(sum(total_advance_amount), 4) AS total_advance_amount, round(sum(total_topup_amount), 4) AS total_topup_amount FROM master""",
    "monthly_stats": """SELECT data_month AS month, count(DISTINCT isdn) AS unique_subscribers,
        round(sum(total_topup_amount), 4) AS total_topup, round(sum(total_advance_amount), 4) AS total_advance
        FROM master GROUP BY data_month""",
    "type_distribution": "SELECT subscriber_type, count(*) AS count FROM master GROUP BY subscriber_type",
    "global_quantiles": "SELECT (SELECT count(*) FROM master) AS panel_rows, " + ", ".join(f"round({c}, 8) AS {c}" for c in (
        "topup_count_q75", "total_topup_amount_q75", "avg_topup_amount_q75", "total_package_value_q75",
        "total_package_value_q90")) + " FROM q",
    "features_advance": _feature_query(_FEATURE_TABLE[30:38]),
    "features_topup": _feature_query(_FEATURE_TABLE[38:53], ("topup_cv", "topup_amount_last_2m", "topup_amount_last_3m")),
    "features_financial": _feature_query(_FEATURE_TABLE[53:66]),
    "features_profile": _feature_query(_FEATURE_TABLE[66:]),
    "phase2_summary": f"""SELECT count(DISTINCT isdn) AS total_subscribers, {len(_FEATURE_TABLE)} AS total_features, """ + ", ".join(
        f"{len(c)} AS {f}_features, '{','.join(c[:10])}' AS {f}_names" for f, c in _FAMILIES.items()) + " FROM snap",
    "stress_distribution": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value, count(*) AS count FROM snap GROUP BY {m}"
        for m in ("financial_stress_score", "usage_intensity")),
    "advance_users": "SELECT isdn FROM advu",
    "never_advanced": "SELECT isdn FROM snap WHERE NOT is_advance_user",
    "standardized_matrix": "SELECT isdn, " + ", ".join(f"round({c}, 6) AS {c}" for c in CENTROID_COLUMNS) + " FROM std",
    "assign_fixed_centroids": "SELECT isdn, cluster FROM clus",
    "segments_by_rank": "SELECT isdn, cluster, is_advance_user, segment FROM seg",
    "cluster_stats": _rate("cluster"),
    "segment_stats": _rate("segment"),
    "segmentation_summary": """SELECT *, group_2_similar + group_2_medium AS group_2_total,
        round((group_2_similar + group_2_medium) / (SELECT count(*) FROM advu), 4) AS expansion_ratio FROM (
        SELECT count(*) AS total_subscribers, count(*) FILTER (segment = 'GROUP_1_EXISTING') AS group_1_existing,
        count(*) FILTER (segment = 'GROUP_2_SIMILAR') AS group_2_similar, count(*) FILTER (segment = 'GROUP_2_MEDIUM') AS group_2_medium,
        count(*) FILTER (segment = 'GROUP_3_UNLIKELY') AS group_3_unlikely FROM seg)""",
    "phase3a_summary": """SELECT count(*) AS total_subscribers, count(DISTINCT cluster) AS num_clusters,
        count(*) FILTER (contains(segment, 'GROUP_2')) AS expansion_target FROM seg""",
    "expansion_targets": "SELECT isdn, cluster, segment FROM seg WHERE segment IN ('GROUP_2_SIMILAR', 'GROUP_2_MEDIUM')",
    "cluster_profiles": "SELECT cluster, rank, feature, round(center, 4) AS center, round(overall_mean, 4) AS overall_mean FROM ("
        "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY center DESC, feature) AS rank FROM ("
        + " UNION ALL ".join(f"""SELECT cluster, '{f}' AS feature, avg({f}) AS center, (SELECT avg({f}) FROM seg) AS overall_mean
                                 FROM seg GROUP BY cluster""" for f in CLUSTER_FEATURES) + ")) WHERE rank <= 5",
    "offers": "SELECT * FROM recs",
    "offers_group2": _scored(f"({_offers('''(SELECT * FROM seg WHERE segment IN ('GROUP_2_SIMILAR', 'GROUP_2_MEDIUM'))''')})"),
    "service_mix": _mix("scored", "service_type", {"avg_arpu": "arpu", "avg_advance": "advance_amount",
                        "avg_revenue": "revenue_per_advance", "avg_voice_sms_pct": "voice_sms_pct"},
                        {"avg_arpu": 4, "avg_voice_sms_pct": 4}),
    "rules_summary": "SELECT *, " + ", ".join(f"{s}_count / total_subscribers * 100 AS {s}_pct" for s in (
        "easycredit", "mbfg", "ungsanluong")) + """ FROM (SELECT count(*) AS total_subscribers,
        count(*) FILTER (service_type = 'EasyCredit') AS easycredit_count, count(*) FILTER (service_type = 'MBFG') AS mbfg_count,
        count(*) FILTER (service_type = 'ungsanluong') AS ungsanluong_count, sum(revenue_per_advance) AS total_revenue_potential,
        sum(revenue_per_advance) / count(*) AS avg_revenue_per_subscriber FROM scored)""",
    "amount_histogram_6": _hist([0, 5000, 10000, 15000, 25000, 50000, 100000], ["<5k", "5k-10k", "10k-15k", "15k-25k", "25k-50k", ">50k"]),
    "amount_histogram_5": _hist([0, 20000, 30000, 40000, 50000, 100000], ["< 20k", "20-30k", "30-40k", "40-50k", "50k+"]),
    "describe_voice": """SELECT round(avg(voice_sms_pct), 4) AS mean_voice_sms_pct,
        round(quantile_cont(voice_sms_pct, 0.5), 4) AS median_voice_sms_pct FROM scored""",
    "offer_totals": _OFFER_TOTALS.format(n="total_recommendations", t="scored"),
    "offers_by_service": _BY_SERVICE.format(t="scored"),
    "risk_scored": "SELECT * FROM scored",
    "risk_mix": _mix("scored", "bad_debt_risk", {"avg_topup": "topup_amount_last_1m", "avg_advance": "advance_amount",
                     "avg_ratio": "topup_advance_ratio"}, {"avg_topup": 4, "avg_ratio": 4}),
    "risk_by_service": """SELECT service_type, bad_debt_risk, count(*) AS count,
        count(*) / sum(count(*)) OVER (PARTITION BY service_type)::DOUBLE * 100 AS pct_in_service
        FROM scored GROUP BY service_type, bad_debt_risk""",
    "final_distribution": """SELECT service_type, count(*) AS count, sum(revenue_per_advance) / count(*) AS avg_revenue,
        sum(revenue_per_advance) AS total_revenue, count(*) / (SELECT count(*) FROM final) * 100 AS pct,
        sum(revenue_per_advance) / (SELECT sum(revenue_per_advance) FROM final) * 100 AS revenue_share_pct,
        (SELECT count(*) FROM final) / (SELECT count(*) FROM scored) * 100 AS pass_rate_pct FROM final GROUP BY service_type""",
    "risk_summary": """SELECT (SELECT count(*) FROM scored) AS total_subscribers_initial, count(*) AS total_subscribers_filtered,
        count(*) FILTER (service_type = 'EasyCredit') AS easycredit_count, count(*) FILTER (service_type = 'MBFG') AS mbfg_count,
        count(*) FILTER (service_type = 'ungsanluong') AS ungsanluong_count, sum(revenue_per_advance) AS total_revenue_potential,
        sum(revenue_per_advance) / count(*) AS avg_revenue_per_subscriber, count(*) FILTER (bad_debt_risk = 'LOW') AS low_risk_count,
        count(*) FILTER (bad_debt_risk = 'MEDIUM') AS medium_risk_count,
        (SELECT count(*) FROM scored) - count(*) AS high_risk_removed,
        count(*) / (SELECT count(*) FROM scored) * 100 AS pass_rate_pct FROM final""",
    "phase4_totals": _OFFER_TOTALS.format(n="final_recommendations", t="final"),
    "phase4_by_service": _BY_SERVICE.format(t="final"),
    "public_codes": """SELECT service_type AS service_code, CASE service_type WHEN 'EasyCredit' THEN 'Fee' WHEN 'MBFG' THEN 'Free'
        WHEN 'ungsanluong' THEN 'Quota' END AS service_type, count(*) AS count FROM final GROUP BY final.service_type""",
    "monthly_arpu": "SELECT isdn, data_month, " + ", ".join(f"round({c}, 4) AS {c}" for c in ARPU) + " FROM monthly",
    "arpu_stats": "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in (
        "arpu_avg_6m", "arpu_std_6m", "arpu_call_avg", "arpu_sms_avg", "arpu_data_avg")) + ") FROM stats",
    "profile_360": "SELECT * REPLACE (round(arpu_avg_6m, 4) AS arpu_avg_6m, round(arpu_std_6m, 4) AS arpu_std_6m) FROM prof",
    "priority": """SELECT isdn, round_even(customer_value_score * advance_readiness_score / 100, 2) AS priority_score,
        customer_value_score * advance_readiness_score / 100 AS priority_raw FROM prof""",
    "insights": """SELECT isdn, 'Classified as ' || user_type || ' based on revenue breakdown' AS reason_text,
        concat_ws('; ', CASE WHEN arpu_avg_6m > 2000 THEN 'ARPU ổn định' END,
                  CASE WHEN topup_frequency = 'Thường xuyên' THEN 'Topup thường xuyên' END,
                  CASE WHEN topup_advance_ratio >= 3 THEN 'Tỷ lệ topup/ứng cao' END,
                  CASE WHEN bad_debt_risk = 'LOW' THEN 'Rủi ro thấp' END) AS strengths,
        topup_advance_ratio >= 2 AS ratio_ok, topup_frequency = 'Thường xuyên' AS frequency_ok,
        coalesce(arpu_growth_rate >= 0, false) AS growth_ok, user_type = 'Heavy Data User' AS cross_sell_data FROM prof""",
    "eligibility": """WITH e AS (SELECT c_name AS isdn, rec.* EXCLUDE (isdn), rec.isdn IS NOT NULL AS listed
            FROM customer LEFT JOIN rec ON c_name = rec.isdn),
        d AS (SELECT *, CASE WHEN NOT listed THEN 'ISDN không có trong danh sách recommendation'
            WHEN bad_debt_risk <> 'LOW' THEN 'Risk level ' || bad_debt_risk || ' - chỉ chấp nhận LOW risk'
            WHEN customer_value_score < 60 THEN 'Customer value score quá thấp: ' || CAST(CAST(customer_value_score AS DOUBLE) AS VARCHAR) || '/100'
            END AS reason FROM e)
        SELECT isdn, reason IS NULL AS eligible, reason, CASE WHEN reason IS NULL THEN service_type END AS service_type,
            CASE WHEN reason IS NULL THEN CAST(advance_amount AS DOUBLE) END AS advance_amount,
            CASE WHEN reason IS NULL THEN CAST(revenue_per_advance AS DOUBLE) END AS revenue_per_advance,
            CAST(customer_value_score AS DOUBLE) AS customer_value_score,
            CASE WHEN reason IS NULL THEN CAST(advance_readiness_score AS DOUBLE) END AS advance_readiness_score, bad_debt_risk,
            CASE WHEN reason IS NULL THEN user_type END AS user_type, CASE WHEN reason IS NULL THEN arpu_trend END AS arpu_trend FROM d""",
    "profile_summary": " UNION ALL ".join(f"""SELECT '{c}' AS dimension, {c} AS value, count(*) AS count,
        count(*) / (SELECT count(*) FROM prof) * 100 AS pct FROM prof WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("user_type", "arpu_trend")),
    "score_ranges": """SELECT min(customer_value_score) AS min_value, max(customer_value_score) AS max_value,
        sum(customer_value_score) / count(*) AS avg_value, min(advance_readiness_score) AS min_readiness,
        max(advance_readiness_score) AS max_readiness, sum(advance_readiness_score) / count(*) AS avg_readiness FROM prof""",
    "subscriber_stats": """SELECT count(*) AS total_subscribers, sum(advance_amount) AS total_advance_amount,
        sum(revenue_per_advance) AS total_revenue, sum(advance_amount) / count(*) AS avg_advance_amount,
        sum(revenue_per_advance) / count(*) AS avg_revenue, round(avg(arpu), 4) AS avg_arpu FROM final""",
    "subscriber_breakdown": " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS count FROM rec GROUP BY {c}" for c in ("service_type", "bad_debt_risk")),
    "serving_metadata": " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({e} AS VARCHAR) AS value FROM rec" for f, e in _META.items()),
    "serving_recommendations": f"""SELECT isdn, subscriber_type, service_type, cluster_group, bad_debt_risk, arpu_trend, user_type,
        topup_frequency_class, {_DOUBLES}, CAST(priority_score AS DOUBLE) AS priority_score, recommendation_date FROM rec""",
    "serving_profiles": f"""SELECT isdn, subscriber_type, service_type, cluster_group, bad_debt_risk, arpu_trend, user_type,
        topup_frequency_class, {_DOUBLES}, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in (
        "arpu_first_month", "arpu_last_month", "topup_min_amount", "topup_max_amount", "risk_score", "revenue_potential"))
        + ", classification_reason, strengths, profile_date FROM sprof",
    "recommendation_stats": "SELECT * FROM recstats",
    "sync_report": f"""SELECT 'service' AS section, service_type AS item, count(*) AS count, {_sum('advance_amount')} AS total_advance,
        {_sum('revenue_per_advance')} AS total_revenue FROM rec GROUP BY service_type
        UNION ALL SELECT 'risk', bad_debt_risk, count(*), NULL, NULL FROM rec GROUP BY bad_debt_risk
        UNION ALL SELECT 'table', 'recommendations', count(*), NULL, NULL FROM rec
        UNION ALL SELECT 'table', 'subscriber_360_profiles', count(*), NULL, NULL FROM sprof
        UNION ALL SELECT 'table', 'subscriber_monthly_arpu', count(*), NULL, NULL FROM smon""",
    "top_by_service": f"SELECT {_SHORT} FROM rec WHERE service_type = 'Fee' ORDER BY rec.priority_score DESC, isdn LIMIT 100",
    "campaign_list": f"""SELECT * FROM (SELECT {_SHORT} FROM rec WHERE service_type = 'Free' ORDER BY rec.priority_score DESC, isdn LIMIT 60)
        WHERE bad_debt_risk = 'LOW'""",
    "score_range": f"""SELECT {_SHORT} FROM rec WHERE service_type = 'Quota' AND rec.priority_score BETWEEN 70 AND 100
        ORDER BY rec.priority_score DESC, isdn LIMIT 100""",
    "high_value_low_risk": f"""SELECT {_SHORT} FROM rec WHERE bad_debt_risk = 'LOW' AND customer_value_score >= 70
        AND advance_readiness_score >= 80 ORDER BY rec.priority_score DESC, isdn LIMIT 10000""",
    "service_index": f"SELECT *, {_NOW} + INTERVAL 30 DAY AS expires_at FROM sidx",
    "risk_index": f"SELECT bad_debt_risk, isdn, {_NOW} + INTERVAL 30 DAY AS expires_at FROM rec",
    "cluster_index": f"SELECT cluster_group, isdn, {_NOW} + INTERVAL 30 DAY AS expires_at FROM rec",
    "index_sizes": " UNION ALL ".join(f"SELECT CAST({c} AS VARCHAR) AS set_name, count(*) AS members FROM rec GROUP BY {c}"
                                      for c in ("bad_debt_risk", "cluster_group", "service_type")),
    "membership": "SELECT c_name AS isdn, c_name IN (SELECT isdn FROM rec WHERE bad_debt_risk = 'LOW') AS is_member FROM customer",
    "search_page": """WITH f AS (SELECT isdn, service_type, bad_debt_risk FROM rec WHERE contains(lower(isdn), 'er#0000')
            AND service_type = 'Quota' AND bad_debt_risk = 'LOW')
        SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) > 70 FROM f) AS has_more,
               (SELECT CAST(ceil(count(*) / 50) AS BIGINT) FROM f) AS pages FROM f ORDER BY isdn LIMIT 50 OFFSET 20""",
    "bulk_lookup": f"""SELECT {_SHORT}, CAST(advance_amount AS DOUBLE) AS advance_amount FROM rec
        WHERE isdn IN (SELECT isdn FROM n5 WHERE data_month = '202508')""",
    "campaign_update": f"""SELECT isdn, CASE WHEN isdn IN (SELECT isdn FROM campaign WHERE accepted) THEN {_LATER} ELSE updated_at END
        AS updated_at FROM rec""",
    "profile_history": f"""SELECT isdn, arpu_trend, {_HISTORY} AS position, data_month AS month, """ + ", ".join(
        f"round(monthly.{c}, 4) AS {c}" for c in ARPU) + " FROM monthly JOIN stats USING (isdn)",
    "rec_documents": f"SELECT * FROM ({_DOC_ROWS}) WHERE value IS NOT NULL AND value <> ''",
    "profile_documents": """SELECT 'profile:' || isdn AS key, service_type AS service, arpu_trend AS trend, bad_debt_risk AS risk,
        user_type, topup_frequency_class AS frequency_class, nullif(customer_value_score, 0) AS customer_value,
        data_month AS month, round(monthly.arpu_total, 4) AS arpu_total FROM prof JOIN monthly USING (isdn)""",
    "live_documents": f"SELECT 'rec:' || isdn AS key, {_LATER} + INTERVAL 7 DAY AS expires_at FROM rec",
    "read_documents": f"""SELECT key, field, value FROM ({_DOC_ROWS}) WHERE field IN ('advance_amount', 'bad_debt_risk')
        AND key IN (SELECT 'rec:' || isdn FROM sidx WHERE rank = 0)""",
    "arpu_chart": """SELECT isdn, data_month, 'T' || substr(data_month, 5) AS label, round(arpu_total, 4) AS arpu_total,
        round(greatest(CASE WHEN max(arpu_total) OVER w > 0 THEN arpu_total / max(arpu_total) OVER w * 100 ELSE 0.0 END, 5.0), 4) AS height
        FROM monthly WINDOW w AS (PARTITION BY isdn)""",
    "q01": f"SELECT {_SHORT} FROM rec WHERE isdn IN (SELECT isdn FROM best)",
    "q02": f"""SELECT isdn, arpu_trend, {_HISTORY} AS position, data_month AS month, CAST(smon.arpu_total AS DOUBLE) AS arpu_total
        FROM smon JOIN stats USING (isdn) WHERE isdn IN (SELECT isdn FROM best)""",
    "q03": """SELECT isdn, subscriber_type, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in (
        "advance_amount", "revenue_per_advance", "customer_value_score", "advance_readiness_score", "priority_score"))
        + " FROM rec WHERE service_type = 'Fee' ORDER BY rec.priority_score DESC, isdn LIMIT 100",
    "q04": _REVENUE.format(total="total_revenue"),
    "q05": _REVENUE.format(total="total_revenue_potential"),
    "q06": "SELECT isdn, service_type, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in (
        "advance_amount", "revenue_per_advance", "customer_value_score", "advance_readiness_score"))
        + """ FROM rec WHERE bad_debt_risk = 'LOW' AND rec.customer_value_score >= 70 AND rec.advance_readiness_score >= 80
        ORDER BY rec.priority_score DESC, isdn LIMIT 1000""",
    "q07": f"""SELECT service_type, arpu_trend, count(*) AS count, {_mean('arpu_avg_6m')} AS avg_arpu,
        {_mean('arpu_growth_rate')} AS avg_growth_rate FROM rec GROUP BY service_type, arpu_trend""",
    "q08": f"""SELECT user_type, count(*) AS count, {_mean('customer_value_score')} AS avg_value_score,
        {_mean('revenue_call_pct')} AS avg_call_pct, {_mean('revenue_sms_pct')} AS avg_sms_pct,
        {_mean('revenue_data_pct')} AS avg_data_pct FROM rec WHERE user_type IS NOT NULL GROUP BY user_type""",
    "q09": f"""SELECT cluster_group, count(*) AS subscriber_count, {_mean('customer_value_score')} AS avg_value,
        {_mean('arpu_avg_6m')} AS avg_arpu, count(*) FILTER (bad_debt_risk = 'LOW') AS low_risk_count,
        count(*) FILTER (bad_debt_risk = 'MEDIUM') AS medium_risk_count FROM rec GROUP BY cluster_group""",
    "q10": "SELECT data_month, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ARPU)
        + " FROM smon WHERE isdn IN (SELECT isdn FROM best)",
    "q11": f"SELECT data_month, {_mean('arpu_total')} AS avg_arpu, count(*) AS subscriber_count FROM smon GROUP BY data_month",
    "q12": f"""SELECT service_type, count(*) AS total_count, {_sum('advance_amount')} AS total_advance,
        {_sum('revenue_per_advance')} AS total_revenue, {_mean('customer_value_score')} AS avg_value_score FROM rec GROUP BY service_type""",
    "q13": f"""SELECT service_type, bad_debt_risk, count(*) AS count, {_mean('advance_amount')} AS avg_advance
        FROM rec GROUP BY service_type, bad_debt_risk""",
    "q14": f"""SELECT count(*) AS total, {_sum('advance_amount')} AS total_advance, {_sum('revenue_per_advance')} AS total_revenue,
        {_mean('customer_value_score')} AS avg_value FROM rec WHERE service_type = 'Quota'""",
    "q15": "SELECT service_type, count(*) AS count FROM rec GROUP BY service_type",
    "q16": f"""SELECT isdn, service_type, CASE WHEN isdn IN (SELECT isdn FROM campaign WHERE accepted) THEN {_LATER} ELSE updated_at END
        AS updated_at FROM rec""",
    "q17": """SELECT 'recommendations' AS table_name, count(*) AS rows FROM rec
        UNION ALL SELECT 'subscriber_360_profiles', count(*) FROM sprof UNION ALL SELECT 'subscriber_monthly_arpu', count(*) FROM smon""",
    "q18": "SELECT isdn, service_type, bad_debt_risk FROM rec ORDER BY isdn LIMIT 5",
    "q19": f"SELECT service_type, count(*) AS count, {_sum('advance_amount')} AS total_advance FROM rec GROUP BY service_type",
    "upsert_recommendations": f"""SELECT isdn, service_type, bad_debt_risk,
            CAST(advance_amount AS DOUBLE) + CASE WHEN service_type = 'Fee' THEN 1000 ELSE 0 END AS advance_amount,
            CAST(priority_score AS DOUBLE) AS priority_score, CASE WHEN service_type = 'Fee' THEN {_LATER} ELSE updated_at END AS updated_at
        FROM rec UNION ALL
        SELECT 'new:' || isdn, service_type, bad_debt_risk, CAST(advance_amount AS DOUBLE), CAST(priority_score AS DOUBLE), updated_at
        FROM rec WHERE service_type = 'Free'""",
    "upsert_profiles": f"""SELECT isdn, user_type,
        CAST(revenue_potential AS DOUBLE) * CASE WHEN bad_debt_risk = 'LOW' THEN 2 ELSE 1 END AS revenue_potential,
        CASE WHEN bad_debt_risk = 'LOW' THEN {_LATER} ELSE updated_at END AS updated_at FROM sprof""",
    "insert_new": """SELECT isdn, data_month, CAST(smon.arpu_total + CASE WHEN bad_debt_risk = 'LOW' THEN 0 ELSE 1 END AS DOUBLE) AS arpu_total
        FROM smon JOIN rec USING (isdn)""",
    "quality_report": " UNION ALL ".join(_CHECKS),
    "reconcile": """SELECT 'recommendation has document' AS check_name, CAST(0 AS BIGINT) AS violations FROM rec HAVING count(*) >= 0
        UNION ALL SELECT 'index size ' || r.service_type, abs(n - m) FROM
        (SELECT service_type, count(*) AS n FROM rec GROUP BY service_type) r JOIN
        (SELECT service_type, count(*) AS m FROM sidx GROUP BY service_type) i USING (service_type)""",
    "csv_ingest": "SELECT * FROM monthcounts",
    "file_inventory": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 1 AS file_count, count(*) AS row_count, true AS dated FROM {t} HAVING count(*) > 0" for t in (
            "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "serving_rejects": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values, CAST(0 AS BIGINT) AS n_rejected FROM {step}"
        for t, step, columns in (
            ("N1", "n1", ARPU), ("N2", "n2", ("package_price", "package_cycle")), ("N4", "n4", ("amount",)),
            ("N5", "n5", ("topup_amount",)), ("monthly", "smon", ARPU),
            ("recommendations", "rec", (
                "advance_amount", "revenue_per_advance", "cluster_group", "arpu_avg_6m", "arpu_std_6m", "arpu_min_6m",
                "arpu_max_6m", "arpu_growth_rate", "revenue_call_pct", "revenue_sms_pct", "revenue_data_pct", "topup_frequency",
                "topup_avg_amount", "topup_advance_ratio", "customer_value_score", "advance_readiness_score", "priority_score")))
        for c in columns),
    "sample_risk": "SELECT bad_debt_risk, isdn FROM rec WHERE bad_debt_risk = 'LOW' ORDER BY md5(isdn || '42'), isdn LIMIT 100",
    "csv_inventory": "SELECT DISTINCT source, source || '_month=' || data_month AS name, data_month AS month FROM monthcounts",
}
FINAL["phase1_unreduced"] = f"""SELECT * REPLACE ((SELECT count(*) FROM n10 LEFT JOIN n1 USING (isdn, data_month)) AS total_records)
    FROM ({FINAL['phase1_summary']})"""
FINAL["csv_master"] = FINAL["monthly_stats"]


def oracle_queries() -> dict[str, str]:
    return {name: with_steps(sql) for name, sql in FINAL.items()}
