"""The registered queries in SQL over the driver's tables (DuckDB dialect).

Each query is a final SELECT over the common table expressions below, which state the
fixture mapping and the Silver model independently of the Spark code.
"""

from __future__ import annotations

from lossledger import schemas
from lossledger.functions.tokens import DEVELOPMENT_KEY, pads
from lossledger.operators.rates import LATENCY_BOUNDS


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def token(text: str, key: bytes = DEVELOPMENT_KEY) -> str:
    """The keyed token of a SQL text expression."""
    inner_pad, outer_pad = pads(key)
    inner = f"unhex(sha256({_blob(inner_pad)} || encode(lower(trim({text})))))"
    return f"'tok_' || left(sha256({_blob(outer_pad)} || {inner}), 24)"


_STATE = "chr(CAST(65 + {0} % 26 AS INTEGER)) || chr(CAST(65 + ({0} * 7) % 26 AS INTEGER))"

CTES: dict[str, str] = {}

CTES["ev_policy"] = f"""
  SELECT o_orderkey * 10 AS fault_key, o_orderkey AS pos,
    'pol-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS event_id,
    CASE o_orderstatus WHEN 'F' THEN 'policy.created' ELSE 'policy.updated' END AS event_type,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS BIGINT) AS event_version,
    o_orderdate AS occurred_at, o_orderdate AS ingested_at,
    'policy-admin-' || (n_nationkey % 3) AS producer,
    CAST(o_custkey AS VARCHAR) AS policy_id, 'cus-' || o_custkey AS customer_id,
    c_name AS customer_name, replace(c_name, '#', '.') || '@Example.com' AS customer_email,
    lower(c_mktsegment) AS line_of_business, {_STATE.format('n_nationkey')} AS state,
    CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + 365 AS expiration_date,
    c_acctbal AS annual_premium, o_totalprice AS coverage_limit,
    CAST((o_orderkey % 4 + 1) * 500 AS DOUBLE) AS deductible,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'cancelled' ELSE 'expired' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

CTES["ev_claim"] = f"""
  SELECT l_orderkey * 10 + l_linenumber AS fault_key, l_partkey AS pos,
    'clm-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber AS event_id,
    CASE l_linenumber WHEN 1 THEN 'claim.opened' ELSE 'claim.updated' END AS event_type,
    CAST(1 AS BIGINT) AS event_version, l_shipdate AS occurred_at, l_shipdate AS ingested_at,
    'claims-desk-' || (l_suppkey % 4) AS producer,
    CAST(l_orderkey AS VARCHAR) AS claim_id, CAST(o_custkey AS VARCHAR) AS policy_id,
    'Claimant ' || l_suppkey AS claimant_name, 'Claimant.' || l_suppkey || '@Example.com' AS claimant_email,
    CAST(o_orderdate AS DATE) AS loss_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(l_partkey % 15 AS INTEGER) AS TIMESTAMP) AS reported_at,
    ['hail', 'burst_pipe', 'rear_end', 'break_in', 'lightning'][l_linenumber % 5 + 1] AS claim_type,
    {_STATE.format('l_suppkey')} AS state,
    l_extendedprice AS reserve_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) * 10 AS DOUBLE) AS paid_amount,
    ['open', 'investigating', 'approved', 'denied', 'closed'][l_partkey % 5 + 1] AS status,
    'desk-' || CAST(l_suppkey % 23 AS VARCHAR) AS adjuster_id,
    l_suppkey % 5 + 1 AS severity,
    ['letter', 'branch', 'agent', 'partner_api'][l_suppkey % 4 + 1] AS source_system,
    l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["ev_payment"] = """
  SELECT l_orderkey * 10 + l_linenumber AS fault_key, l_partkey AS pos,
    'pay-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber AS event_id,
    'payment.issued' AS event_type, CAST(1 AS BIGINT) AS event_version,
    l_shipdate AS occurred_at, l_shipdate AS ingested_at, 'treasury-' || l_linestatus AS producer,
    'pmt-' || l_orderkey || '-' || l_linenumber AS payment_id, CAST(l_orderkey AS VARCHAR) AS claim_id,
    CAST(l_shipdate AS DATE) AS payment_date,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) * 100 AS DOUBLE) AS amount,
    ['advance', 'rest', 'fee', 'refund'][l_linenumber % 4 + 1] AS payment_type,
    'Payee ' || l_suppkey AS payee_name,
    CASE l_returnflag WHEN 'R' THEN 'void' WHEN 'A' THEN 'cleared' ELSE 'issued' END AS payment_status
  FROM lineitem"""


def _newest(source: str, rule: str) -> str:
    return f"""SELECT * FROM {source} WHERE {rule}
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, pos DESC) = 1"""


CTES["stg_policies"] = f"""
  SELECT event_id, event_type, occurred_at, ingested_at, policy_id, customer_id,
    {token('customer_name')} AS customer_name_token, {token('customer_email')} AS customer_email_token,
    line_of_business, state, effective_date, expiration_date,
    CAST(annual_premium AS DECIMAL(18,2)) AS annual_premium,
    CAST(coverage_limit AS DECIMAL(18,2)) AS coverage_limit,
    CAST(deductible AS DECIMAL(18,2)) AS deductible, status
  FROM ({_newest('ev_policy', 'annual_premium > 0')})"""

CTES["stg_claims"] = f"""
  SELECT event_id, event_type, occurred_at, ingested_at, claim_id, policy_id,
    {token('claimant_name')} AS claimant_name_token, {token('claimant_email')} AS claimant_email_token,
    loss_date, reported_at, claim_type, state,
    CAST(reserve_amount AS DECIMAL(18,2)) AS reserve_amount,
    CAST(paid_amount AS DECIMAL(18,2)) AS reported_paid_amount,
    status, adjuster_id, CAST(severity AS INTEGER) AS severity, source_system
  FROM ({_newest('ev_claim', 'reserve_amount >= 0')})"""

CTES["stg_payments"] = f"""
  SELECT event_id, event_type, occurred_at, ingested_at, payment_id, claim_id, payment_date,
    CAST(amount AS DECIMAL(18,2)) AS amount, payment_type,
    {token('payee_name')} AS payee_name_token, payment_status
  FROM ({_newest('ev_payment', 'amount > 0')})"""

_ATTRIBUTES = """policy_id, customer_id, customer_name_token, customer_email_token, line_of_business, state,
    effective_date, expiration_date, annual_premium, coverage_limit, deductible, status"""

CTES["dim_policy_history"] = f"""
  SELECT md5(policy_id || '|' || strftime(occurred_at, '%Y-%m-%d %H:%M:%S') || '+00') AS policy_version_key,
    {_ATTRIBUTES}, occurred_at AS valid_from,
    min(occurred_at) OVER following AS valid_to, count(*) OVER following = 0 AS is_current
  FROM stg_policies
  WINDOW following AS (PARTITION BY policy_id ORDER BY occurred_at, event_id
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""

CTES["dim_policy_current"] = """
  SELECT * EXCLUDE (valid_to, is_current) FROM dim_policy_history WHERE is_current"""

CTES["latest_claim"] = """
  SELECT s.* FROM stg_claims s JOIN (
    SELECT claim_id, max({'t': occurred_at, 'e': event_id}) AS top FROM stg_claims GROUP BY claim_id
  ) m ON s.claim_id = m.claim_id AND s.event_id = m.top.e"""

CTES["payments_by_claim"] = """
  SELECT claim_id,
    CAST(coalesce(sum(amount) FILTER (WHERE payment_status <> 'void'), 0) AS DECIMAL(38,2)) AS cleared_payment_amount,
    count(*) FILTER (WHERE payment_status <> 'void') AS payment_count
  FROM stg_payments GROUP BY claim_id"""

CTES["measured"] = """
  SELECT latest_claim.*, pol.line_of_business, pol.coverage_limit,
    CAST(coalesce(pay.cleared_payment_amount, 0) AS DECIMAL(38,2)) AS cleared_payment_amount,
    coalesce(pay.payment_count, 0) AS payment_count,
    CAST(CASE WHEN coalesce(pay.cleared_payment_amount, 0) > reported_paid_amount
         THEN pay.cleared_payment_amount ELSE reported_paid_amount END AS DECIMAL(38,2)) AS paid_amount,
    CAST(CASE WHEN reserve_amount > reported_paid_amount THEN reserve_amount - reported_paid_amount
         ELSE 0 END AS DECIMAL(38,2)) AS outstanding_reserve,
    CAST(CAST(reported_at AS DATE) - loss_date AS BIGINT) AS reporting_delay_days
  FROM latest_claim
  LEFT JOIN dim_policy_current pol ON pol.policy_id = latest_claim.policy_id
  LEFT JOIN payments_by_claim pay ON pay.claim_id = latest_claim.claim_id"""

CTES["fct"] = """
  SELECT *, CAST(paid_amount + outstanding_reserve AS DECIMAL(38,2)) AS total_incurred,
    CAST(CASE WHEN points > 100 THEN 100 ELSE points END AS INTEGER) AS risk_score
  FROM (SELECT *, 15 * severity + CASE WHEN reporting_delay_days >= 8 THEN 15 ELSE 0 END
      + CASE WHEN 2 * reserve_amount > coverage_limit THEN 10 ELSE 0 END
      + CASE source_system WHEN 'partner_api' THEN 5 ELSE 0 END AS points FROM measured)"""

CTES["fct_claims_current"] = "SELECT * EXCLUDE (points) FROM fct"

CTES["claims_kpis"] = """
  SELECT count(*) AS total_claims,
    sum(CASE WHEN status IN ('open', 'investigating', 'approved') THEN 1 ELSE 0 END)::BIGINT AS open_claims,
    CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred,
    CAST(sum(paid_amount) AS DECIMAL(38,2)) AS total_paid,
    CAST(sum(outstanding_reserve) AS DECIMAL(38,2)) AS outstanding_reserve,
    sum(CASE WHEN risk_score >= 70 THEN 1 ELSE 0 END)::BIGINT AS high_risk_claims,
    round(avg(reporting_delay_days), 2) AS avg_reporting_delay_days,
    max(occurred_at) AS data_as_of
  FROM fct_claims_current"""

CTES["daily_claim_metrics"] = """
  SELECT loss_date, line_of_business, state, count(*) AS claim_count,
    sum(CASE WHEN status IN ('open', 'investigating', 'approved') THEN 1 ELSE 0 END)::BIGINT AS open_claim_count,
    CAST(sum(paid_amount) AS DECIMAL(38,2)) AS paid_amount,
    CAST(sum(outstanding_reserve) AS DECIMAL(38,2)) AS outstanding_reserve,
    CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred,
    round(avg(risk_score), 2) AS avg_risk_score
  FROM fct_claims_current GROUP BY ALL"""

CTES["high_risk_claims"] = """
  SELECT claim_id, policy_id, loss_date, reported_at, line_of_business, state, status, severity,
    reporting_delay_days, reserve_amount, paid_amount, total_incurred, risk_score, adjuster_id, source_system
  FROM fct_claims_current WHERE risk_score >= 70"""

_FAULT = """CASE WHEN fault_key % 100 = 0 THEN 'first_key_dropped' WHEN fault_key % 101 = 1 THEN 'unknown_key'
      WHEN fault_key % 103 = 2 THEN 'negative_amount' WHEN fault_key % 107 = 3 THEN 'truncated'
      WHEN fault_key % 109 = 4 THEN 'no_offset' WHEN fault_key % 113 = 5 THEN 'bad_status'
      WHEN fault_key % 127 = 6 THEN 'short_id' END"""

# One row per raw line: what the contract must say about it.
CTES["raw"] = f"""
  SELECT 'policy' AS entity, CAST(NULL AS VARCHAR) AS fault, event_id, event_type, event_version, occurred_at,
    producer, annual_premium <= 0 AS natural_fault, 'policy' AS tab, pos, '' AS flag FROM ev_policy
  UNION ALL SELECT 'claim', {_FAULT}, event_id, event_type, event_version, occurred_at, producer, FALSE, 'lineitem',
    pos, l_returnflag FROM ev_claim
  UNION ALL SELECT 'payment', {_FAULT}, event_id, event_type, event_version, occurred_at, producer, amount <= 0,
    'lineitem', pos, '' FROM ev_payment"""

CTES["judged"] = """
  SELECT *, coalesce(fault IN ('unknown_key', 'no_offset', 'short_id', 'truncated'), FALSE) AS bad_envelope,
    coalesce(fault IN ('first_key_dropped', 'negative_amount', 'bad_status'), FALSE) OR natural_fault AS bad_payload
  FROM raw"""

CTES["outcome"] = """
  SELECT *, CASE WHEN bad_envelope OR bad_payload THEN 'rejected' ELSE 'accepted' END AS status,
    CASE WHEN fault = 'truncated' THEN 'JSONDecodeError'
         WHEN bad_envelope OR bad_payload THEN 'ValidationError' END AS error_class
  FROM judged"""

CTES["log"] = """
  SELECT ts, value / 100 AS seconds,
    CASE event_type WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS status,
    CASE event_type WHEN 'click' THEN 'policy' WHEN 'purchase' THEN 'payment'
         WHEN 'error' THEN NULL ELSE 'claim' END AS entity,
    CASE WHEN event_type = 'error' THEN
      ['ValidationError', 'JSONDecodeError', 'UnicodeDecodeError'][user_id % 3 + 1] END AS error_class
  FROM events"""


def sql(final: str) -> str:
    """A statement made of all table expressions and the final SELECT."""
    body = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items())
    return f"WITH {body}\n{final}"


def _rate(keys: str, where: str) -> str:
    return f"""
  SELECT range_end, {keys}, count(*) AS events, count(*) / 300.0::DOUBLE AS per_second
  FROM (SELECT *, unnest(generate_series(1, 5)) AS step FROM log WHERE {where}),
    LATERAL (SELECT date_trunc('minute', ts) + to_minutes(step) AS range_end) GROUP BY ALL"""


def _latency() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS c{i}" for i, b in enumerate(LATENCY_BOUNDS))
    arms, lower, before = [], 0.0, "0"
    for i, bound in enumerate(LATENCY_BOUNDS):
        arms.append(
            f"WHEN c{i} >= 0.95 * n THEN {lower}::DOUBLE + ({bound}::DOUBLE - {lower}::DOUBLE)"
            f" * (0.95::DOUBLE * n - {before}) / (c{i} - {before})"
        )
        lower, before = bound, f"c{i}"
    return f"""
  SELECT range_end, n AS batches, round(CASE {' '.join(arms)} ELSE {LATENCY_BOUNDS[-1]} END, 9) AS latency_seconds
  FROM (SELECT range_end, count(*) AS n, {counts}
    FROM (SELECT *, unnest(generate_series(1, 5)) AS step FROM log),
      LATERAL (SELECT date_trunc('minute', ts) + to_minutes(step) AS range_end) GROUP BY range_end)"""


_ROW_TESTS = """
  SELECT 'dim_policy_history' AS "table", 'not_null_policy_version_key' AS test, count(*) AS failures
    FROM dim_policy_history WHERE policy_version_key IS NULL
  UNION ALL SELECT 'dim_policy_history', 'not_null_policy_id', count(*) FROM dim_policy_history WHERE policy_id IS NULL
  UNION ALL SELECT 'dim_policy_history', 'accepted_values_status', count(*) FROM dim_policy_history
    WHERE NOT (status = 'active' OR status = 'cancelled' OR status = 'expired')
  UNION ALL SELECT 'dim_policy_current', 'not_null_policy_id', count(*) FROM dim_policy_current WHERE policy_id IS NULL
  UNION ALL SELECT 'fct_claims_current', 'not_null_claim_id', count(*) FROM fct_claims_current WHERE claim_id IS NULL
  UNION ALL SELECT 'fct_claims_current', 'not_null_policy_id', count(*) FROM fct_claims_current WHERE policy_id IS NULL
  UNION ALL SELECT 'fct_claims_current', 'accepted_values_status', count(*) FROM fct_claims_current
    WHERE NOT (status = 'open' OR status = 'investigating' OR status = 'approved' OR status = 'denied' OR status = 'closed')
  UNION ALL SELECT 'fct_claims_current', 'not_null_risk_score', count(*) FROM fct_claims_current WHERE risk_score IS NULL
  UNION ALL SELECT 'fct_claims_current', 'non_negative_financials', count(*) FROM fct_claims_current
    WHERE least(reserve_amount, paid_amount, outstanding_reserve, total_incurred) < 0
  UNION ALL SELECT 'fct_claims_current', 'risk_score_range', count(*) FROM fct_claims_current
    WHERE risk_score NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'claims_kpis', 'not_null_total_claims', count(*) FROM claims_kpis WHERE total_claims IS NULL
  UNION ALL SELECT 'dim_policy_history', 'unique_policy_version_key', count(*) FROM
    (SELECT policy_version_key FROM dim_policy_history GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'dim_policy_current', 'unique_policy_id', count(*) FROM
    (SELECT policy_id FROM dim_policy_current GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'fct_claims_current', 'unique_claim_id', count(*) FROM
    (SELECT claim_id FROM fct_claims_current GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'fct_claims_current', 'relationships_policy_id', count(DISTINCT policy_id) FROM fct_claims_current
    WHERE policy_id NOT IN (SELECT policy_id FROM dim_policy_current)"""

_BY_RISK = "ORDER BY risk_score DESC, total_incurred DESC, claim_id"
_NEWEST_DAYS = "ORDER BY loss_date DESC, line_of_business NULLS LAST, state"

# Ids of an earlier batch: all policies and the claims of returned items.
_LEDGER = """(SELECT event_id FROM ev_policy UNION SELECT event_id FROM ev_claim WHERE l_returnflag = 'R')"""

_TAGGED = f"""(SELECT *, CASE WHEN bad_envelope THEN 'rejected'
      WHEN event_id IN (SELECT event_id FROM {_LEDGER}) THEN 'duplicate'
      WHEN bad_payload THEN 'rejected' ELSE 'accepted' END AS outcome FROM judged)"""


def statements() -> dict[str, str]:
    names = (
        "stg_policies stg_claims stg_payments dim_policy_history dim_policy_current latest_claim "
        "payments_by_claim fct_claims_current claims_kpis daily_claim_metrics high_risk_claims"
    ).split()
    finals = {name: f"SELECT * FROM {name}" for name in names}
    finals |= {
        "dim_policy_history_split": "SELECT * FROM dim_policy_history",
        "latest_policy": "SELECT * FROM dim_policy_current",
        "kpis": "SELECT * FROM claims_kpis",
        "kpi_cards": """SELECT total_claims, open_claims, total_incurred, high_risk_claims, data_as_of
          FROM claims_kpis""",
        "run_summary": """SELECT total_claims, open_claims, total_incurred, high_risk_claims, data_as_of
          FROM claims_kpis""",
        "work_queue": f"SELECT * FROM high_risk_claims {_BY_RISK}",
        "high_risk_topk": f"SELECT * FROM high_risk_claims {_BY_RISK} LIMIT 25",
        "attention_list": f"""SELECT claim_id, line_of_business, state, status, severity, risk_score,
          total_incurred, adjuster_id FROM high_risk_claims {_BY_RISK} LIMIT 100""",
        "daily_metrics": f"SELECT * FROM daily_claim_metrics {_NEWEST_DAYS} LIMIT 250",
        "daily_metrics_filtered": f"""SELECT * FROM daily_claim_metrics
          WHERE state = 'BH' AND line_of_business = 'machinery' {_NEWEST_DAYS} LIMIT 5000""",
        "lines_of_business": """SELECT 'All' AS line_of_business UNION
          SELECT line_of_business FROM daily_claim_metrics WHERE line_of_business IS NOT NULL""",
        "volume_by_loss_date": """SELECT loss_date, CAST(sum(claim_count) AS BIGINT) AS claim_count,
          CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred FROM daily_claim_metrics GROUP BY loss_date""",
        "volume_by_loss_date_line": """SELECT loss_date, CAST(sum(claim_count) AS BIGINT) AS claim_count,
          CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred FROM daily_claim_metrics
          WHERE line_of_business = 'household' GROUP BY loss_date""",
        "incurred_by_line": """SELECT line_of_business, CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred
          FROM daily_claim_metrics WHERE line_of_business IS NOT NULL GROUP BY line_of_business""",
        "dq_not_null": "SELECT claim_id, policy_id FROM fct_claims_current WHERE line_of_business IS NULL",
        "dq_unique": """SELECT policy_version_key, count(*) AS occurrences FROM dim_policy_history
          GROUP BY 1 HAVING count(*) > 1""",
        "dq_accepted_values": """SELECT payment_status, count(*) AS occurrences FROM stg_payments
          WHERE payment_status <> 'issued' AND payment_status <> 'cleared' GROUP BY 1""",
        "dq_relationships": """SELECT policy_id, count(*) AS occurrences FROM fct_claims_current
          WHERE policy_id NOT IN (SELECT policy_id FROM dim_policy_current) GROUP BY 1""",
        "dq_non_negative": """SELECT claim_id FROM fct_claims_current
          WHERE least(reserve_amount, paid_amount, outstanding_reserve, total_incurred) < 0""",
        "dq_risk_range": "SELECT claim_id FROM fct_claims_current WHERE risk_score NOT BETWEEN 0 AND 100",
        "data_tests": _ROW_TESTS,
        "slo_metrics": """SELECT count(*) AS total_claims,
          count(*) FILTER (WHERE line_of_business IS NULL) AS orphan_claims,
          count(*) - count(DISTINCT claim_id) AS duplicate_claims, max(occurred_at) AS max_event_time
          FROM fct_claims_current""",
        "slo_report": """SELECT CASE WHEN claims > 0 AND orphans = 0 AND rejected <= 0.02 * source
            THEN 'pass' ELSE 'fail' END AS status,
          claims > 0 AS claims_present, orphans = 0 AS referential_integrity, doubles = 0 AS claim_uniqueness,
          rejected <= 0.02 * source AS rejection_rate_within_slo,
          source AS source_events, rejected AS rejected_events,
          round(rejected::DOUBLE / source, 4) AS rejection_rate, claims AS total_claims,
          strftime(newest, '%Y-%m-%d %H:%M:%S') AS max_event_time
          FROM (SELECT count(*) AS claims, count(*) FILTER (WHERE line_of_business IS NULL) AS orphans,
              count(*) - count(DISTINCT claim_id) AS doubles, max(occurred_at) AS newest FROM fct_claims_current),
            (SELECT count(*) AS source, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM outcome)""",
        "contract_split_counts": """SELECT status, error_class, CASE WHEN NOT bad_envelope THEN entity END AS entity,
          count(*) AS events FROM outcome GROUP BY ALL""",
        "contract_strict_counts": """SELECT status, error_class, CASE WHEN NOT bad_envelope THEN entity END AS entity,
          count(*) AS events FROM outcome GROUP BY ALL""",
        "dead_letter_triage": """SELECT error_class, field, producer, count(*) AS events FROM (
            SELECT error_class, producer, CASE fault WHEN 'unknown_key' THEN 'unexpected'
              WHEN 'no_offset' THEN 'occurred_at' WHEN 'short_id' THEN 'event_id' END AS field
            FROM outcome WHERE bad_envelope AND fault <> 'truncated'
            UNION ALL SELECT error_class, NULL, '' FROM outcome WHERE fault = 'truncated'
            UNION ALL SELECT error_class, producer, CASE fault || entity
              WHEN 'first_key_droppedclaim' THEN 'claim_id' WHEN 'first_key_droppedpayment' THEN 'payment_id'
              WHEN 'negative_amountclaim' THEN 'reserve_amount' WHEN 'negative_amountpayment' THEN 'amount'
              WHEN 'bad_statusclaim' THEN 'status' WHEN 'bad_statuspayment' THEN 'memo' END
            FROM outcome WHERE fault IN ('first_key_dropped', 'negative_amount', 'bad_status')
            UNION ALL SELECT error_class, producer, CASE entity WHEN 'policy' THEN 'annual_premium' ELSE 'amount' END
            FROM outcome WHERE natural_fault AND NOT bad_envelope AND fault IS DISTINCT FROM 'negative_amount')
          GROUP BY ALL""",
        "accepted_events": """SELECT entity, event_id, event_type, event_version, occurred_at, producer,
          CAST(occurred_at AS DATE) AS event_date FROM outcome WHERE status = 'accepted'""",
        "accepted_claim_values": """SELECT event_id, claim_id, policy_id, lower(claimant_email) AS claimant_email,
          strftime(loss_date, '%Y-%m-%d') AS loss_date,
          strftime(reported_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS reported_at,
          reserve_amount, paid_amount, status, severity FROM ev_claim
          WHERE event_id || pos IN (SELECT event_id || pos FROM outcome WHERE status = 'accepted')""",
        "version_drift": """SELECT event_type, event_version, count(*) AS events, event_version <= 1 AS is_supported
          FROM outcome WHERE status = 'accepted' GROUP BY ALL""",
        "freshness": """SELECT entity, max(occurred_at) AS last_ingested_at, max(occurred_at) AS last_occurred_at
          FROM outcome WHERE status = 'accepted' GROUP BY entity""",
        "pii_tokens": f"""SELECT DISTINCT customer_id, {token('customer_name')} AS customer_name_token,
          {token('customer_email')} AS customer_email_token FROM ev_policy""",
        "pii_token_join": f"""SELECT claimant, claims, payments FROM
          (SELECT {token("'Payee ' || l_suppkey")} AS claimant, count(*) AS payments FROM lineitem GROUP BY 1)
          JOIN (SELECT {token("'Payee ' || s_suppkey")} AS claimant, count(*) AS claims FROM supplier GROUP BY 1)
          USING (claimant)""",
        "ledger_anti_join": f"""SELECT entity, event_id, pos FROM raw
          WHERE event_id NOT IN (SELECT event_id FROM {_LEDGER})""",
        "ledger_outcomes": f"""SELECT outcome AS status, count(*) AS events,
          count(DISTINCT CASE WHEN outcome <> 'rejected' THEN event_id END) AS ids
          FROM {_TAGGED} GROUP BY 1""",
        "ingest_totals": f"""SELECT count(*) FILTER (WHERE outcome = 'accepted') AS accepted,
          count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
          count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates FROM {_TAGGED}""",
        "accepted_by_entity": f"""SELECT entity, count(*) AS events FROM {_TAGGED} WHERE outcome = 'accepted'
          GROUP BY 1""",
        "rejected_by_reason": f"""SELECT CASE fault WHEN 'truncated' THEN 'JSONDecodeError' ELSE 'ValidationError' END
          AS error_class, count(*) AS events FROM {_TAGGED} WHERE outcome = 'rejected' GROUP BY 1""",
        "duplicate_total": f"SELECT count(*) AS events FROM {_TAGGED} WHERE outcome = 'duplicate'",
        "last_event": """SELECT arg_max(occurred_at, {'i': ingested_at, 'p': pos}) AS last_event_at FROM ev_policy
          WHERE annual_premium > 0""",
        "line_count": "SELECT count(*) AS lines FROM raw",
        "backfill_range": """SELECT entity, count(*) AS events, min(occurred_at) AS first_at,
          max(occurred_at) AS last_at FROM outcome
          WHERE status = 'accepted' AND occurred_at >= TIMESTAMP '1996-01-01' AND occurred_at < TIMESTAMP '1997-01-01'
          GROUP BY 1""",
        "mixed_records": """SELECT status, error_class, count(*) AS events FROM outcome WHERE entity = 'policy'
          GROUP BY ALL""",
        "kafka_messages": f"""SELECT 'claims.policy.events' AS topic,
          'policy-' || lpad(policy_id, 8, '0') AS "key", count(*) AS messages FROM ev_policy GROUP BY ALL""",
        "event_rate_5m": _rate("entity", "status = 'accepted'"),
        "rejected_rate_5m": _rate("error_class", "status = 'rejected'"),
        "p95_batch_latency": _latency(),
        "bronze_partitions": """SELECT CASE event_type WHEN 'click' THEN 'policy' WHEN 'purchase' THEN 'payment'
            ELSE 'claim' END AS entity, CAST(ts AS DATE) AS event_date, count(*) AS events
          FROM events WHERE event_type <> 'error' GROUP BY ALL""",
        "replay_outcomes": """SELECT run, CASE run WHEN 1 THEN good ELSE 0 END AS accepted, bad AS rejected,
            CASE run WHEN 2 THEN good ELSE 0 END AS duplicates
          FROM (SELECT count(*) FILTER (WHERE event_type <> 'error') AS good,
            count(*) FILTER (WHERE event_type = 'error') AS bad FROM events),
            (SELECT unnest([1, 2]) AS run)""",
    }
    finals["bronze_entities"] = """SELECT CASE event_type WHEN 'click' THEN 'policy' WHEN 'purchase' THEN 'payment'
            ELSE 'claim' END AS entity,
          CASE event_type WHEN 'click' THEN 'policy.created' WHEN 'purchase' THEN 'payment.issued'
            WHEN 'view' THEN 'claim.opened' ELSE 'claim.updated' END AS event_type,
          CAST(1 AS BIGINT) AS event_version, 'DEFAULT_PRODUCER' AS producer, count(*) AS events, min(ts) AS first_at
          FROM events WHERE event_type <> 'error' GROUP BY ALL""".replace("DEFAULT_PRODUCER", schemas.DEFAULT_PRODUCER)
    finals["batch_throughput"] = """SELECT count(*) AS source_rows,
          round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS accepted_share FROM events"""
    finals["contract_strict_feed"] = """SELECT 'rejected' AS status,
          CASE WHEN event_type = 'error' THEN ['ValidationError', 'JSONDecodeError', 'UnicodeDecodeError'][user_id % 3 + 1]
            ELSE 'ValidationError' END AS error_class, CAST(NULL AS VARCHAR) AS entity, count(*) AS events
          FROM events GROUP BY ALL"""
    finals["archive_lines"] = """SELECT 'stored' AS archive, count(*) AS lines FROM raw
          UNION ALL SELECT 'absent', 0"""
    finals["published_kpis"] = f"""SELECT *, unnest(['name', 'log']) AS reader FROM ({finals['claims_kpis']})"""
    finals["rerun_replaces"] = """SELECT 'policy' AS entity, CAST(ts AS DATE) AS event_date, count(*) AS events
          FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL
          UNION ALL SELECT 'dead letters', NULL, 0"""
    finals["stored_dead_letters"] = """SELECT CASE f WHEN 'json' THEN 'JSONDecodeError' WHEN 'utf8' THEN 'UnicodeDecodeError'
            ELSE 'ValidationError' END AS error_class,
          CASE f WHEN 'contract' THEN 'customer_id' ELSE '' END AS fields,
          f = 'utf8' AS has_bytes, true AS has_text, count(*) AS events
          FROM (SELECT ['contract', 'json', 'utf8'][user_id % 3 + 1] AS f FROM events WHERE event_type = 'error')
          GROUP BY ALL"""
    finals["backfill_twice"] = """SELECT run, CASE run WHEN 1 THEN n ELSE 0 END AS accepted,
          CASE run WHEN 2 THEN n ELSE 0 END AS duplicates, n AS stored
          FROM (SELECT count(*) AS n FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-15'),
          (SELECT unnest([1, 2]) AS run)"""
    finals["stream_ingest"] = finals["bronze_partitions"]
    finals["history_incremental"] = finals["dim_policy_history"]
    finals["daily_metrics_delta"] = finals["daily_claim_metrics"]
    # Cut lines keep their time; lines that aren't UTF-8 can't be read for any range.
    finals["archive_index"] = """SELECT count(*) AS events, 2 AS days_opened FROM events
          WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10 12:00:00'
            AND NOT (event_type = 'error' AND user_id % 3 > 0)"""
    finals["stream_permuted"] = finals["bronze_partitions"]
    finals["stored_report"] = finals["slo_report"]
    finals["dq_non_negative_found"] = """SELECT claim_id, CAST(-reserve_amount - 1 AS DECIMAL(18,2)) AS reserve_amount
          FROM latest_claim WHERE severity = 4"""
    finals["dq_risk_range_found"] = "SELECT claim_id FROM latest_claim WHERE status = 'denied'"
    finals["contract_event_types"] = """SELECT CASE WHEN status = 'rejected' OR pos % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
          CASE WHEN pos % 7 = 0 AND error_class IS NULL THEN 'ValidationError' ELSE error_class END AS error_class,
          CASE WHEN NOT bad_envelope AND pos % 7 > 0 THEN entity END AS entity, count(*) AS events FROM outcome GROUP BY ALL"""
    keys = {"environment": b"key of the environment", "given": b"key of the caller", "neither": DEVELOPMENT_KEY}
    finals["pii_key_lookup"] = " UNION ALL ".join(
        f"SELECT '{by}' AS key, {token('payee_name', key)} AS token FROM (SELECT DISTINCT payee_name FROM ev_payment)"
        for by, key in keys.items()
    )
    fields = {"policy": ("policy_id", "annual_premium"), "claim": ("claim_id", "reserve_amount"), "payment": ("payment_id", "amount")}
    finals["kafka_values"] = " UNION ALL ".join(
        f"""SELECT 'claims.{entity}.events' AS topic, event_id, event_version, occurred_at, producer,
          {key} AS payload_key, CAST({amount} AS DOUBLE) AS amount FROM ev_{entity}"""
        for entity, (key, amount) in fields.items()
    )
    finals["event_rate_restated"] = finals["event_rate_5m"]
    finals["outcome_counters"] = """SELECT status AS outcome, entity, error_class, count(*) AS "rows" FROM log GROUP BY ALL"""
    finals["p95_latency_sketch"] = """SELECT range_end, count(*) AS batches, true AS within
          FROM (SELECT *, unnest(generate_series(1, 5)) AS step FROM log),
            LATERAL (SELECT date_trunc('minute', ts) + to_minutes(step) AS range_end) GROUP BY range_end"""
    # Eight runs of a level become one of the next.
    finals["ledger_levels"] = """SELECT batch, count(*) FILTER (WHERE event_id % 12 = batch) AS new_ids,
          count(*) FILTER (WHERE event_id % 12 = batch - 1) AS known_ids,
          CAST((batch + 1) // 8 + (batch + 1) % 8 AS INTEGER) AS runs
          FROM events, (SELECT CAST(unnest(range(12)) AS INTEGER) AS batch) GROUP BY batch"""
    finals["gate_keeps_published"] = """SELECT unnest(['run-1', 'run-2']) AS run, unnest(['pass', 'refused']) AS status,
          count(*) AS total_claims, CAST(sum(total_incurred) AS DECIMAL(38,2)) AS total_incurred
          FROM fct_claims_current WHERE line_of_business IS NOT NULL"""
    finals["stored_fact"] = finals["claims_kpis"]
    return {name: sql(final) for name, final in finals.items()}
