"""Oracle SQL: for each query the same result in DuckDB SQL."""

from __future__ import annotations

from tidewarden import model
from tidewarden.operators import chaos, metrics
from tidewarden.plans.feed import RATES
from tidewarden.plans.oracle_base import (ASSESSED, CHECKOUTS, ISO, _literal, _object, _quoted, hx, one_of,
                                          over_checkouts, over_judged, over_raw)

H = 3600
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def stamp(expr: str) -> str:
    return f"strftime({expr}, {STAMP})"


BRONZE = """bronze AS (
  SELECT value ->> '$.event_id' AS event_id,
         try_strptime(substr(value ->> '$.event_time', 1, 19), '%Y-%m-%dT%H:%M:%S') AS event_time,
         value ->> '$.customer_id' AS customer_id, value ->> '$.session_id' AS session_id,
         value ->> '$.order_id' AS order_id, value ->> '$.product_id' AS product_id,
         try_cast(try_cast(value ->> '$.amount' AS double) AS decimal(18,2)) AS amount,
         value ->> '$.currency' AS currency, value ->> '$.payment_method' AS payment_method,
         value ->> '$.payment_status' AS payment_status, value ->> '$.device' AS device,
         value ->> '$.country' AS country, value ->> '$.source_version' AS source_version,
         arrived_at AS ingestion_time
  FROM (SELECT * FROM raw WHERE json_valid(value)) WHERE value ->> '$.event_id' IS NOT NULL)"""


def over_bronze(select: str) -> str:
    return over_raw(", " + BRONZE + " " + select)


SLICES = f"""slices AS (
  SELECT source, (floor(epoch_us(arrived_at) / {H}000000)::bigint * {H}) AS slice,
         count(*) AS total, count(*) FILTER (bad) AS bad FROM assessed GROUP BY ALL)"""


def over_slices(select: str) -> str:
    return over_judged(", " + SLICES + " " + select)


KIND = """CASE json_type(value, '$."' || key || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null'
   WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean'
   WHEN 'DOUBLE' THEN CASE WHEN isfinite(try_cast(value ->> ('$."' || key || '"') AS double))
        AND try_cast(value ->> ('$."' || key || '"') AS double) = floor(try_cast(value ->> ('$."' || key || '"') AS double))
        THEN 'integer' ELSE 'float' END END"""
ENTRIES = f"""entries AS (
  SELECT "offset", strftime(arrived_at, '%Y-%m-%d') AS period, value ->> '$.source_version' AS schema_version,
         key, {KIND} AS kind, value ->> ('$."' || key || '"') AS text
  FROM (SELECT *, unnest(json_keys(value)) AS key FROM raw WHERE json_valid(value)))"""

LATENCY = """latency AS (
  SELECT source, greatest(0, (epoch_us(arrived_at) - epoch_us(try_strptime(
    substr(value ->> '$.event_time', 1, 19), '%Y-%m-%dT%H:%M:%S'))) / 1000.0) AS latency
  FROM (SELECT * FROM raw WHERE json_valid(value)) WHERE value ->> '$.event_time' IS NOT NULL)"""


def over_latency(select: str) -> str:
    return over_raw(", " + LATENCY + " " + select)


def over_latency_at(select: str) -> str:
    return over_raw(", " + LATENCY.replace("SELECT source, greatest", """SELECT source, "offset", arrived_at, greatest""") + " " + select)


BREAKER = SLICES + f""",
numbered_slices AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY slice) AS rn,
         list({{'at': slice, 't': total, 'b': bad}}) OVER (PARTITION BY source ORDER BY slice
           RANGE BETWEEN {6 * H - 1} PRECEDING AND CURRENT ROW) AS recent
  FROM slices),
walk AS (
  SELECT DISTINCT source, 0::bigint AS rn, 0::bigint AS slice, 0::bigint AS total, 0::bigint AS bad,
         'CLOSED' AS state_before, 'CLOSED' AS state, 0::bigint AS opened_at, 0::bigint AS sampled,
         -1::bigint AS cleared_at, 0::bigint AS seen, 0::bigint AS failed FROM slices
  UNION ALL
  SELECT source, rn, slice, total, bad, before,
    CASE WHEN before = 'CLOSED' THEN CASE WHEN seen >= 20 AND failed > 0.05 * seen THEN 'OPEN' ELSE 'CLOSED' END
         WHEN before = 'OPEN' THEN CASE WHEN slice >= opened_at + {12 * H} THEN 'HALF_OPEN' ELSE 'OPEN' END
         WHEN bad > 0 THEN 'OPEN' WHEN seen >= 10 THEN 'CLOSED' ELSE 'HALF_OPEN' END,
    CASE WHEN (before = 'CLOSED' AND seen >= 20 AND failed > 0.05 * seen) OR (before = 'HALF_OPEN' AND bad > 0)
         THEN slice ELSE opened_at END,
    CASE WHEN before = 'HALF_OPEN' THEN seen ELSE 0 END,
    CASE WHEN before = 'HALF_OPEN' AND bad = 0 AND seen >= 10 THEN slice ELSE cleared_at END,
    seen, failed
  FROM (
    SELECT n.source, n.rn, n.slice, n.total, n.bad, w.state AS before, w.opened_at, w.cleared_at,
      CASE w.state WHEN 'CLOSED' THEN list_sum(list_transform(
             list_filter(n.recent, lambda x: x.at > w.cleared_at), lambda x: x.t))::bigint
           WHEN 'OPEN' THEN n.total ELSE w.sampled + n.total END AS seen,
      CASE w.state WHEN 'CLOSED' THEN list_sum(list_transform(
             list_filter(n.recent, lambda x: x.at > w.cleared_at), lambda x: x.b))::bigint
           ELSE n.bad END AS failed
    FROM walk w JOIN numbered_slices n ON n.source = w.source AND n.rn = w.rn + 1)),
states AS (SELECT * FROM walk WHERE rn > 0),
changes AS (
  SELECT md5(source || '|' || slice || '|' || state) AS incident_id, *,
         {stamp('make_timestamp(slice * 1000000)')} AS at_text FROM states WHERE state <> state_before)"""


def over_breaker(select: str) -> str:
    return f"WITH RECURSIVE {ASSESSED}, {BREAKER} {select}"


DAILY = ENTRIES + """,
day_totals AS (SELECT strftime(arrived_at, '%Y-%m-%d') AS period, count(*) AS events
               FROM raw WHERE json_valid(value) GROUP BY ALL),
day_kinds AS (SELECT period, key, kind, count(*) AS n FROM entries WHERE kind <> 'null' GROUP BY ALL),
day_fields AS (SELECT period, key, sum(n) AS n, arg_max(kind, (n, kind)) AS top, bool_or(kind = 'float') AS has_float
               FROM day_kinds GROUP BY ALL),
day_enums AS (SELECT period, key, list_sort(list(DISTINCT text)) AS enum FROM entries
              WHERE key IN ('payment_method', 'payment_status') AND kind = 'string' GROUP BY ALL),
daily AS (
  SELECT f.period AS schema_version, f.key AS field,
         CASE WHEN top IN ('integer', 'float') AND has_float THEN 'float' ELSE top END AS type,
         f.n = t.events AS required, e.enum
  FROM day_fields f JOIN day_totals t USING (period) LEFT JOIN day_enums e USING (period, key)),
pairs AS (SELECT * FROM (SELECT lag(v) OVER (ORDER BY v) AS old_version, v AS new_version
          FROM (SELECT DISTINCT schema_version AS v FROM daily)) WHERE old_version IS NOT NULL),
matched AS (
  SELECT coalesce(o.old_version, n.old_version) AS old_version, coalesce(o.new_version, n.new_version) AS new_version,
         coalesce(o.field, n.field) AS field, o.type AS ot, n.type AS nt, o.required AS orq, n.required AS nrq,
         o.field IS NOT NULL AS in_old, n.field IS NOT NULL AS in_new, o.enum IS NOT NULL OR n.enum IS NOT NULL AS has_enum,
         coalesce(o.enum, []) AS oe, coalesce(n.enum, []) AS ne
  FROM (SELECT p.*, d.field, d.type, d.required, d.enum FROM pairs p JOIN daily d ON d.schema_version = old_version) o
  FULL JOIN (SELECT p.*, d.field, d.type, d.required, d.enum FROM pairs p JOIN daily d ON d.schema_version = new_version) n
    ON o.old_version = n.old_version AND o.new_version = n.new_version AND o.field = n.field),
deltas AS (
  SELECT *, list_sort(list_filter(ne, lambda x: NOT list_contains(oe, x))) AS gained,
         list_sort(list_filter(oe, lambda x: NOT list_contains(ne, x))) AS lost FROM matched),
change_rows AS (
  SELECT old_version, new_version, field, 1 AS phase, 0 AS step, 'FIELD_REMOVED' AS change_type,
         '{"type":"' || ot || '","required":' || orq || '}' AS old_value, NULL AS new_value, true AS breaking,
         'Removed ' || CASE WHEN orq THEN 'required' ELSE 'optional' END || ' field ''' || field || '''' AS description
  FROM deltas WHERE in_old AND NOT in_new
  UNION ALL SELECT old_version, new_version, field, 2, 0, 'FIELD_ADDED', NULL,
         '{"type":"' || nt || '","required":' || nrq || '}', nrq,
         CASE WHEN nrq THEN 'Added required field ''' || field || ''' without default'
              ELSE 'Added optional field ''' || field || '''' END
  FROM deltas WHERE in_new AND NOT in_old
  UNION ALL SELECT old_version, new_version, field, 3, 1, 'FIELD_TYPE_CHANGED', '"' || ot || '"', '"' || nt || '"',
         NOT (ot = 'integer' AND nt = 'float'),
         CASE WHEN ot = 'integer' AND nt = 'float' THEN 'Safe type promotion for field '''
              ELSE 'Incompatible type change for field ''' END || field || ''' (' || ot || ' -> ' || nt || ')'
  FROM deltas WHERE in_old AND in_new AND ot <> nt
  UNION ALL SELECT old_version, new_version, field, 3, 2, 'FIELD_REQUIRED_CHANGED', orq::varchar, nrq::varchar,
         nrq, 'Field ''' || field || CASE WHEN nrq THEN ''' changed from optional to required'
              ELSE ''' relaxed from required to optional' END
  FROM deltas WHERE in_old AND in_new AND orq <> nrq
  UNION ALL SELECT old_version, new_version, field, 3, 3, 'ENUM_VALUE_ADDED', to_json(oe)::varchar, to_json(ne)::varchar,
         false, 'Enum field ''' || field || ''' expanded with new value(s): ' || array_to_string(gained, ', ')
  FROM deltas WHERE in_old AND in_new AND has_enum AND len(gained) > 0
  UNION ALL SELECT old_version, new_version, field, 3, 4, 'ENUM_VALUE_REMOVED', to_json(oe)::varchar, to_json(ne)::varchar,
         true, 'Enum field ''' || field || ''' removed value(s): ' || array_to_string(lost, ', ')
  FROM deltas WHERE in_old AND in_new AND has_enum AND len(lost) > 0)"""


def over_daily(select: str) -> str:
    return over_raw(", " + DAILY + " " + select)


def _legacy(seed: int, percent: float, kinds: list[str]) -> str:
    fires = f"{hx('p', 0)} < {round(percent / 100 * 2 ** 32)}"
    return over_checkouts(f""", picks AS (
      SELECT *, CASE WHEN {fires} THEN {one_of(kinds, hx('p', 1))} END AS error_type, {hx('p', 2)} AS back,
             {hx('p', 3)} AS u
      FROM (SELECT *, md5(event_id || '|legacy|{seed}') AS p,
                   row_number() OVER (PARTITION BY "partition" ORDER BY "offset") AS idx FROM checkouts)),
    donors AS (
      SELECT a.*, b.event_id AS donor FROM picks a LEFT JOIN picks b ON a.error_type = 'duplicate_event_id'
        AND a.idx > 1 AND a."partition" = b."partition" AND b.idx = a.idx - 1 - a.back % greatest(least(a.idx - 1, 1000), 1))""")


def _legacy_payload() -> str:
    x = {n: _literal(n) for n in model.EVENT_FIELDS}

    def put(name: str, cond: str, text: str) -> None:
        x[name] = f"(CASE WHEN {cond} THEN {text} ELSE {x[name]} END)"

    put("amount", "error_type = 'null_amount'", "'null'")
    put("customer_id", "error_type = 'null_customer_id'", "'null'")
    put("amount", "error_type = 'negative_amount'", "CASE WHEN amount = 0 THEN '-1499.00' ELSE (-abs(amount))::varchar END")
    put("event_id", "error_type = 'duplicate_event_id'", _quoted("coalesce(donor, 'evt_duplicate_00001')"))
    put("currency", "error_type = 'invalid_currency'", _quoted(one_of(chaos.BAD_CURRENCIES, "u")))
    put("quantity", "error_type = 'wrong_data_type' AND u % 3 = 0", "'\"two\"'")
    put("amount", "error_type = 'wrong_data_type' AND u % 3 = 1", _quoted("amount"))
    put("unit_price", "error_type = 'wrong_data_type' AND u % 3 = 2", _quoted("unit_price"))
    put("event_time", "error_type = 'future_timestamp'", _quoted(f"strftime(arrived_at + INTERVAL 1 HOUR, {ISO})"))
    removable = [f for f in model.EVENT_FIELDS if f not in ("event_id", "event_type")]
    for i, n in enumerate(removable):
        put(n, f"error_type = 'missing_required_field' AND u % {len(removable)} = {i}", "NULL")
    return _object(x)


def _weighted(pairs: list[tuple], number: str) -> str:
    total, cases = 0.0, ""
    for value, weight in pairs[:-1]:
        total += weight
        cases += f" WHEN {number} < {round(total * 2 ** 32)} THEN {value!r}"
    return f"CASE{cases} ELSE {pairs[-1][0]!r} END"


def _histogram(bounds: list[float], group: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {group}{b if b else 'NULL'} AS le, count(*) FILTER (latency / 1000.0 <= {b or 1e300}) AS cumulative "
        f"FROM latency {'GROUP BY source' if group else ''}" for b in [*bounds, None])


RULE_ROWS = ", ".join(f"('{c}', '{s}')" for c, s in model.RULES.items())
MODE_ROWS = ", ".join(f"('{m}', {float(r)})" for m, r in RATES.resolved().items())
MIDDLE = f"(SELECT floor((epoch_us(min(arrived_at)) + epoch_us(max(arrived_at))) / {2 * H}000000)::bigint * {H} FROM raw)"
CUT = f"(SELECT make_timestamp({MIDDLE} * 1000000))"
IDS = """ids AS (SELECT "partition", "offset", arrived_at, source, value,
  CASE WHEN json_valid(value) THEN value ->> '$.event_id' END AS event_id,
  CASE WHEN json_valid(value) THEN value ->> '$.amount' END AS amount FROM raw)"""


def _number_or_text(name: str) -> str:
    return f"({name}::double)::varchar" if name in ("unit_price", "amount") else _literal(name)


# Each window's own samples, with the fall of a counter found among them.
_INCREASES = f""", polled AS (SELECT source, le, "at", sum(n) OVER (PARTITION BY source, le, "at" // 86400 ORDER BY "at")::double AS c FROM (
    SELECT source, le, floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} AS "at", count(*) FILTER (latency / 1000.0 <= le) AS n
    FROM latency, (SELECT unnest({metrics.CONSUMER_BOUNDS} || ['inf'::double])::double AS le) GROUP BY ALL)),
  ends AS (SELECT unnest(range(min("at") // {3 * H} * {3 * H}, max("at") + {9 * H}, {3 * H})) AS "end" FROM polled),
  members AS (SELECT source, le, "end", "at", c, lag(c) OVER (PARTITION BY source, le, "end" ORDER BY "at") AS before
    FROM polled JOIN ends ON "at" > "end" - {6 * H} AND "at" <= "end"),
  spans AS (SELECT source, le, "end", count(*) AS n, min("at") AS a, max("at") AS b, arg_min(c, "at") AS first,
      arg_max(c, "at") - arg_min(c, "at") + coalesce(sum(before) FILTER (c < before), 0) AS grown FROM members GROUP BY ALL HAVING count(*) > 1),
  reach AS (SELECT *, (b - a)::double AS length, (b - a) / (n - 1)::double AS mean, a - ("end" - {6 * H}) AS lead, "end" - b AS tail FROM spans),
  fronts AS (SELECT *, CASE WHEN lead < mean * 1.1 THEN lead ELSE mean / 2 END AS front,
      CASE WHEN tail < mean * 1.1 THEN tail ELSE mean / 2 END AS back FROM reach),
  grown AS (SELECT source, le, "end" AS "at", grown * (length + back
      + CASE WHEN grown > 0 AND first >= 0 THEN least(front, length * first / grown) ELSE front END) / length AS increase FROM fronts)"""


ORACLE: dict[str, str] = {
    "bronze_ingest": over_bronze(
        f"SELECT * REPLACE ({stamp('event_time')} AS event_time, amount::double AS amount, "
        f"{stamp('ingestion_time')} AS ingestion_time) FROM bronze"),
    "bronze_completeness": over_bronze(
        "SELECT count(*) AS total, count(event_id) AS event_id_count, count(event_time) AS event_time_count, "
        "count(customer_id) AS customer_id_count, count(amount) AS amount_count FROM bronze"),
    "bronze_null_presence": over_bronze("SELECT " + ", ".join(
        f"count(*) > count({c}) AS {c}_has_null" for c in model.BRONZE.fieldNames()) + " FROM bronze"),
    "bronze_duplicate_count": over_bronze(
        'SELECT count(*) AS "rows", count(DISTINCT event_id) AS distinct_ids, '
        "count(*) - count(DISTINCT event_id) AS duplicates FROM bronze"),
    "projection_limit": over_bronze(
        "SELECT event_id, customer_id FROM bronze ORDER BY event_id, customer_id NULLS FIRST LIMIT 10"),
    "required_enforced": over_bronze(
        "SELECT payment_status, count(*) AS events FROM bronze WHERE event_time IS NOT NULL "
        "AND customer_id IS NOT NULL AND amount IS NOT NULL GROUP BY 1"),
    "producer_records": over_checkouts(
        f"""SELECT customer_id AS key, {_object({n: f"coalesce({_number_or_text(n)}, 'null')"
                                                  for n in [*model.EVENT_FIELDS, 'coupon_code']})} AS value
        FROM checkouts"""),
    "corrupted_payloads": over_raw(
        f"""SELECT "partition", "offset", source, fault_mode, value, {stamp('arrived_at')} AS arrived_at FROM raw"""),
    "mixed_stream_counts": over_raw(
        """SELECT "partition", CASE WHEN fault_mode IS NULL THEN 'clean' ELSE 'faulty' END AS kind,
        count(*) AS events FROM raw GROUP BY ALL"""),
    "snapshot_list": over_raw(
        """ SELECT floor("offset" * 3 / ((SELECT max("offset") FROM raw) + 1))::bigint AS batch_id, count(*) AS "rows" FROM raw GROUP BY 1"""),
    "snapshot_rows": over_raw(
        """, b AS (SELECT floor("offset" * 3 / ((SELECT max("offset") FROM raw) + 1))::int AS batch_id, "partition", "offset", value FROM raw)
        SELECT * FROM b WHERE batch_id <= 1"""),
    "text_lines": over_raw("SELECT value FROM raw"),
    "event_failures": over_judged(
        """SELECT "partition", "offset", event_id, route, failure_reason, failure_type,
        round(quality_score, 6) AS quality_score FROM judged"""),
    "failures_by_rule": over_judged(
        f"""SELECT rule, severity, count(*) FILTER (list_contains(failures, rule)) AS events
        FROM judged, (VALUES {RULE_ROWS}) r(rule, severity) GROUP BY ALL"""),
    "route_counts": over_judged(
        "SELECT 'validation' AS pipeline_stage, route, count(*) AS events FROM judged GROUP BY ALL"),
    "silver_rows": over_judged(
        f"""SELECT event_id, {stamp('event_ts')} AS event_time, event_type, customer_id, session_id, order_id,
        product_id, quantity::int AS quantity, round(price_n, 2) AS unit_price, round(amount_n, 2) AS amount, currency,
        payment_method, payment_status, device, country, event_source AS source, source_version,
        {stamp('arrived_at')} AS processed_at, 1.0::double AS quality_score FROM judged WHERE route = 'valid'"""),
    "quarantine_rows": over_judged(
        f"""SELECT event_id, event_time, value AS raw_payload, failure_reason, failure_type, schema_version,
        {stamp('arrived_at')} AS detected_at, 'validation' AS pipeline_stage FROM judged WHERE route = 'invalid'"""),
    "dead_letters": over_judged(
        f"""SELECT "partition", "offset", {stamp('arrived_at')} AS arrived_at, value FROM judged WHERE route = 'dlq'"""),
    "audit_rows": over_judged(
        f"""SELECT md5("partition" || '|' || "offset" || '|' || rule) AS check_id, event_id, rule AS check_name,
        CASE WHEN hit THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN hit THEN severity ELSE 'INFO' END AS severity,
        CASE WHEN hit THEN rule END AS failure_reason, {stamp('arrived_at')} AS observed_at,
        'validation' AS pipeline_stage
        FROM (SELECT *, list_contains(failures, rule) AS hit FROM judged, (VALUES {RULE_ROWS}) r(rule, severity))"""),
    "quality_score_by_source": over_judged(
        "SELECT source, round(avg(quality_score), 6) AS avg_score, round(min(quality_score), 6) AS min_score "
        "FROM judged GROUP BY 1"),
    "fault_detection": over_judged(
        """SELECT fault_mode, rule, count(*) AS events FROM (SELECT fault_mode,
        unnest(CASE WHEN len(failures) = 0 THEN [NULL] ELSE failures END) AS rule FROM judged) GROUP BY ALL"""),
    "invalid_currencies": _legacy(3, 40.0, ["invalid_currency"])
    + f"SELECT {one_of(chaos.BAD_CURRENCIES, 'u')} AS currency, count(*) AS events FROM donors "
      "WHERE error_type IS NOT NULL GROUP BY 1",
    "legacy_errors": _legacy(5, 60.0, model.LEGACY_ERRORS)
    + f"""SELECT "partition", "offset", error_type, {_legacy_payload()} AS value FROM donors""",
    "typed_probe": over_raw(
        f""", {ENTRIES} SELECT key, kind, count(*) AS events FROM entries GROUP BY ALL"""),
    "amount_check": over_judged(
        """SELECT source, count(*) FILTER (d) AS "off", count(*) FILTER (NOT d) AS exact,
        count(*) FILTER (d IS NULL) AS unknown
        FROM (SELECT source, abs(amount_n - round(quantity_n * price_n, 2)) >= 0.001 AS d FROM judged) GROUP BY 1"""),
    "duplicates_flagged": over_raw(
        f""", {IDS} SELECT "offset", event_id, event_id IS NOT NULL
        AND row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, "partition", "offset") > 1 AS is_duplicate FROM ids"""),
    "first_arrivals": over_raw(
        f""", {IDS} SELECT "offset", event_id, value FROM ids QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, "partition", "offset") = 1"""),
    "lineitem_first_per_line":
        f"""SELECT l_orderkey || '-' || l_linenumber AS line_id, {stamp('l_shipdate')} AS l_shipdate, l_partkey,
        l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1""",
    "lineitem_duplicate_count":
        """SELECT count(*) AS "rows", count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_ids,
        count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""",
    "new_since_landed": over_raw(
        f""", {IDS} SELECT event_id, "offset" FROM ids WHERE arrived_at >= {CUT} AND event_id IS NOT NULL
        AND event_id NOT IN (SELECT event_id FROM ids WHERE arrived_at < {CUT} AND event_id IS NOT NULL)"""),
    "late_events": over_raw(
        f""", seen AS (SELECT *, try_strptime(substr(CASE WHEN json_valid(value) THEN value ->> '$.event_time' END,
          1, 19), '%Y-%m-%dT%H:%M:%S') AS event_ts FROM raw),
        marked AS (SELECT *, max(CASE WHEN event_ts <= arrived_at + INTERVAL 5 MINUTE THEN event_ts END) OVER (
          PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
          FROM seen)
        SELECT "partition", "offset", {stamp('mark')} AS mark,
          coalesce(event_ts < mark - INTERVAL 5 SECOND, false) AS is_late FROM marked"""),
    "arrival_index": over_raw(
        """SELECT source, "offset", row_number() OVER (PARTITION BY source ORDER BY "offset") AS idx FROM raw"""),
    "newest_samples": over_raw(
        f"""SELECT source, "offset", {stamp('arrived_at')} AS arrived_at FROM raw
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY "offset" DESC) <= 1000"""),
    "probe_sample": over_raw(
        """SELECT source, "offset" FROM raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY arrived_at, "partition", "offset") <= 50"""),
    "error_rate_tumbling": over_judged(
        f"""SELECT source, floor(epoch_us(arrived_at) / {6 * H}000000)::bigint * {6 * H} AS window_start,
        count(*) AS total, count(*) FILTER (bad) AS bad, round(count(*) FILTER (bad) / count(*), 6) AS error_rate
        FROM assessed GROUP BY ALL"""),
    "error_rate_sliding": over_judged(
        f"""SELECT source, window_start, count(*) AS total, count(*) FILTER (bad) AS bad,
        round(count(*) FILTER (bad) / count(*), 6) AS error_rate
        FROM (SELECT source, bad, unnest(range(h - {5 * H}, h + 1, {H})) AS window_start
              FROM (SELECT *, floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} AS h FROM assessed))
        GROUP BY ALL"""),
    "error_rate_moving": over_slices(
        f"""SELECT source, slice, total, bad, window_total, window_bad, round(window_bad / window_total, 6) AS window_rate
        FROM (SELECT *, sum(total) OVER w AS window_total, sum(bad) OVER w AS window_bad FROM slices
        WINDOW w AS (PARTITION BY source ORDER BY slice RANGE BETWEEN {5 * H} PRECEDING AND CURRENT ROW))"""),
    "breaker_states": over_breaker(
        "SELECT source, slice, total, bad, state_before, state, seen, failed FROM states"),
    "incidents": over_breaker(
        "SELECT incident_id, source, state_before AS from_state, state AS to_state, at_text AS opened_at, "
        "round(failed / seen, 6) AS error_rate, seen AS total, failed AS bad FROM changes"),
    "alert_feed": over_breaker(
        """SELECT md5(incident_id || '|alert') AS alert_id, incident_id, source, at_text AS raised_at,
        CASE state WHEN 'OPEN' THEN 'CRITICAL' WHEN 'HALF_OPEN' THEN 'WARNING' ELSE 'INFO' END AS severity,
        source || ': ' || state_before || ' -> ' || state || ', ' || failed || ' of ' || seen || ' events failed'
        AS message FROM changes"""),
    "control_signals": over_breaker(
        """SELECT source, CASE state WHEN 'OPEN' THEN 'PAUSE' WHEN 'HALF_OPEN' THEN 'PROBE' ELSE 'RESUME' END AS signal,
        at_text AS issued_at, state_before || '->' || state AS reason FROM changes"""),
    "incident_context": over_breaker(
        """SELECT source, at_text AS opened_at, incident_id, state_before AS from_state, state AS to_state,
        seen AS total, failed AS bad, round(failed / seen, 6) AS error_rate, total AS slice_total, changes.bad AS slice_bad FROM changes"""),
    "gated_events": over_breaker(
        f"""SELECT a.source, a."offset", CASE s.state_before WHEN 'OPEN' THEN 'divert' WHEN 'HALF_OPEN' THEN 'probe'
        ELSE 'pass' END AS gate FROM assessed a JOIN states s ON a.source = s.source
        AND s.slice = floor(epoch_us(a.arrived_at) / {H}000000)::bigint * {H}"""),
    "released_events": over_breaker(
        f"""SELECT a.source, a."offset", s.slice, (SELECT min(c.slice) FROM states c WHERE c.source = s.source AND c.slice > s.slice
          AND c.state = 'CLOSED' AND c.state_before <> 'CLOSED') AS released_at
        FROM assessed a JOIN states s ON a.source = s.source AND s.slice = floor(epoch_us(a.arrived_at) / {H}000000)::bigint * {H}
        WHERE s.state_before = 'OPEN' AND released_at IS NOT NULL"""),
    "volume_anomalies": over_raw(
        f""", k AS (SELECT source, floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} AS slice, count(*) AS events
          FROM raw GROUP BY ALL),
        every AS (SELECT source, unnest(range(min(slice), (SELECT max(slice) FROM k) + 1, {H})) AS slice FROM k GROUP BY source),
        c AS (SELECT source, slice, coalesce(events, 0) AS events FROM every LEFT JOIN k USING (source, slice)),
        s AS (SELECT *, count(*) OVER w AS n, avg(events) OVER w AS m, stddev_samp(events) OVER w AS sd FROM c
          WINDOW w AS (PARTITION BY source ORDER BY slice ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
        z AS (SELECT source, slice, events, CASE WHEN n >= 5 AND sd > 0 THEN (events - m) / sd END AS z_score FROM s)
        SELECT source, slice, events, round(z_score, 6) AS z_score, coalesce(abs(z_score) > 2.5, false) AS is_anomaly
        FROM z"""),
    "value_anomalies":
        """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, round(z, 5) AS z_score FROM (
        SELECT l.*, CASE WHEN n >= 10 AND sd > 0 THEN (l_extendedprice - m) / sd END AS z FROM lineitem l JOIN (
          SELECT l_partkey, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd
          FROM lineitem GROUP BY 1) s USING (l_partkey)) WHERE abs(z) > 2.0""",
    "fault_statistics": over_raw(
        f""", t AS (SELECT count(*) AS total_events, count(fault_mode) AS faulty_events FROM raw),
        f AS (SELECT fault_mode, count(*) AS n FROM raw WHERE fault_mode IS NOT NULL GROUP BY 1)
        SELECT m.fault_mode, coalesce(n, 0) AS events, round(coalesce(n, 0) / total_events * 100, 6)
          AS observed_pct, m.pct::double AS configured_pct, total_events, total_events - faulty_events AS clean_events,
          faulty_events, round(faulty_events / total_events * 100, 6) AS overall_faulty_pct
        FROM (VALUES {MODE_ROWS}) m(fault_mode, pct) CROSS JOIN t LEFT JOIN f ON f.fault_mode = m.fault_mode"""),
    "faults_by_type": over_raw(
        "SELECT fault_mode AS fault_type, count(*) AS faults FROM raw WHERE fault_mode IS NOT NULL GROUP BY 1"),
    "latency_percentiles": over_latency(
        """SELECT count(latency) AS samples, round(avg(latency), 6) AS avg, round(quantile_cont(latency, 0.5), 6) AS p50,
        round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99,
        round(max(latency), 6) AS max FROM latency"""),
    "latency_by_source": over_latency(" UNION ALL ".join(
        f"SELECT source, {q}::double AS quantile, round(quantile_cont(latency, {q}), 6) AS value FROM latency GROUP BY source"
        for q in (0.5, 0.95, 0.99))),
    "shipping_delay_percentiles": " UNION ALL ".join(
        f"""SELECT o_orderpriority, {q}::double AS quantile, round(quantile_cont(
        date_diff('day', o_orderdate, l_shipdate)::double, {q}), 6) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""" for q in (0.05, 0.5, 0.95)),
    "latency_histogram": over_latency(" UNION ALL ".join(
        f"SELECT '{n}' AS le, count(*) FILTER (latency / 1000.0 <= {b}) AS cumulative FROM latency"
        for n, b in [*((str(b), b) for b in metrics.CONSUMER_BOUNDS), ("Infinity", "1e300")])),
    "producer_histogram": over_latency(
        f"SELECT source, le::double AS le, cumulative FROM ({_histogram(metrics.PRODUCER_BOUNDS, 'source, ')})"),
    "histogram_quantiles": over_latency(
        f""", b AS ({_histogram(metrics.CONSUMER_BOUNDS, 'source, ')}),
        c AS (SELECT source, coalesce(le::double, 'inf'::double) AS le, cumulative FROM b),
        e AS (SELECT *, coalesce(lag(cumulative) OVER w, 0) AS prev, coalesce(lag(le) OVER w, 0) AS lo,
          max(cumulative) OVER (PARTITION BY source) AS total FROM c WINDOW w AS (PARTITION BY source ORDER BY le)),
        f AS (SELECT *, q * total AS r FROM e, (VALUES (0.5::double), (0.95::double), (0.99::double)) v(q)
          WHERE cumulative >= q * total
          QUALIFY row_number() OVER (PARTITION BY source, q ORDER BY le) = 1)
        SELECT source, q AS quantile, round(1000 * CASE WHEN isinf(le) THEN lo
          ELSE lo + (le - lo) * (r - prev) / (cumulative - prev) END, 4) AS value FROM f"""),
    "bucket_increases": over_latency_at(
        f"""{_INCREASES} SELECT source, CASE WHEN isfinite(le) THEN le END AS le, "at", round(increase, 6) AS increase FROM grown"""),
    "quantiles_over_time": over_latency_at(
        f"""{_INCREASES}, c AS (SELECT "at", le, sum(increase) AS cumulative FROM grown GROUP BY ALL),
        e AS (SELECT *, coalesce(lag(cumulative) OVER w, 0) AS prev, coalesce(lag(le) OVER w, 0) AS lo,
          max(cumulative) OVER (PARTITION BY "at") AS total FROM c WINDOW w AS (PARTITION BY "at" ORDER BY le)),
        f AS (SELECT *, q * total AS r FROM e, (VALUES (0.5::double), (0.95::double), (0.99::double)) v(q)
          WHERE cumulative >= q * total AND total > 0
          QUALIFY row_number() OVER (PARTITION BY "at", q ORDER BY le) = 1)
        SELECT "at", q AS quantile, round(1000 * CASE WHEN isinf(le) THEN lo WHEN cumulative = prev THEN le
          ELSE lo + (le - lo) * (r - prev) / (cumulative - prev) END, 4) AS value FROM f"""),
    "lag_over_time": over_raw(
        f""", p AS (SELECT "partition", floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} + {H} AS "at", max("offset") + 1 AS h
          FROM raw GROUP BY ALL),
        polls AS (SELECT "partition", "at", max(h) OVER (PARTITION BY "partition" ORDER BY "at") AS high FROM p),
        g AS (FROM (VALUES ('bronze-writer', 3), ('audit-reader', 7), ('idle-reader', NULL)) g("group", every)),
        commits AS (SELECT "partition", "group", "at" + {H} AS "at", high AS committed FROM polls, g
          WHERE "at" % (every * {H}) = 0 AND ("group" <> 'audit-reader' OR "partition" < 2))
        SELECT 'checkout-events' AS topic, "partition", "group", "at", high, committed,
          greatest(0, coalesce(high - committed, 0)) AS lag
        FROM (SELECT polls.*, "group" FROM polls, g) l ASOF LEFT JOIN commits c USING ("partition", "group", "at")"""),
    "ingestion_delay": over_bronze(
        """SELECT payment_status, count(d) AS events, round(min(d), 4) AS min_ms, round(max(d), 4) AS max_ms
        FROM (SELECT payment_status, (epoch_us(ingestion_time) - epoch_us(event_time)) / 1000.0 AS d FROM bronze)
        GROUP BY 1"""),
    "live_metrics": over_latency_at(
        f""", placed AS (SELECT floor("offset" * 3 / ((SELECT max("offset") FROM raw) + 1))::bigint AS batch_id, latency FROM latency),
        b AS (SELECT batch_id, le, count(*) FILTER (latency / 1000.0 <= le) AS cumulative
          FROM placed, (SELECT unnest({metrics.CONSUMER_BOUNDS} || ['inf'::double])::double AS le) GROUP BY ALL),
        e AS (SELECT *, coalesce(lag(cumulative) OVER w, 0) AS prev, coalesce(lag(le) OVER w, 0) AS lo,
          max(cumulative) OVER (PARTITION BY batch_id) AS total FROM b WINDOW w AS (PARTITION BY batch_id ORDER BY le)),
        f AS (SELECT *, q * total AS r FROM e, (VALUES (0.5::double), (0.95::double)) v(q)
          WHERE cumulative >= q * total AND total > 0 QUALIFY row_number() OVER (PARTITION BY batch_id, q ORDER BY le) = 1),
        p AS (SELECT batch_id, q, 1000 * CASE WHEN isinf(le) THEN lo WHEN cumulative = prev THEN le
          ELSE lo + (le - lo) * (r - prev) / (cumulative - prev) END AS v FROM f),
        n AS (SELECT floor("offset" * 3 / ((SELECT max("offset") FROM raw) + 1))::bigint AS batch_id, count(*) AS input_rows FROM raw GROUP BY 1)
        SELECT batch_id, input_rows, (SELECT max(cumulative) FROM b WHERE b.batch_id = n.batch_id) AS timed_rows,
          (SELECT round(v, 4) FROM p WHERE p.batch_id = n.batch_id AND q = 0.5::double) AS p50_ms,
          (SELECT round(v, 4) FROM p WHERE p.batch_id = n.batch_id AND q = 0.95::double) AS p95_ms, 0::bigint AS behind FROM n"""),
    "lag_report": over_raw(
        f""", h AS (SELECT "partition", max("offset") + 1 AS high FROM raw GROUP BY 1),
        c AS (SELECT "partition", max("offset") + 1 AS committed FROM raw
          WHERE epoch_us(arrived_at) < {MIDDLE} * 1000000 AND "partition" < 2
          GROUP BY 1)
        SELECT "partition", high, committed, CASE WHEN committed IS NULL THEN 0
          ELSE greatest(0, high - committed) END AS lag FROM h LEFT JOIN c USING ("partition")"""),
    "lag_totals": over_raw(
        f""", h AS (SELECT "partition", max("offset") + 1 AS high FROM raw GROUP BY 1),
        c AS (SELECT "partition", max("offset") + 1 AS committed FROM raw
          WHERE epoch_us(arrived_at) < {MIDDLE} * 1000000 AND "partition" < 2
          GROUP BY 1)
        SELECT sum(greatest(0, high - committed))::bigint AS total_lag, max(greatest(0, high - committed)) AS max_lag
        FROM h JOIN c USING ("partition")"""),
    "throughput": over_raw(
        f""", c AS (SELECT floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} AS slice, count(*) AS total,
          count(fault_mode) AS bad FROM raw GROUP BY 1),
        r AS (SELECT *, (sum(total) OVER w)::bigint AS generated, (sum(bad) OVER w)::bigint AS errors,
          min(slice) OVER () AS first FROM c WINDOW w AS (ORDER BY slice))
        SELECT slice, total, generated, errors, round(total / {H}, 8) AS current_rate,
          round(generated / (slice + {H} - first), 8) AS average_rate, round(errors / generated * 100, 6) AS error_pct
        FROM r"""),
}

_POLLS = f""", per AS (SELECT source, floor(epoch_us(arrived_at) / {H}000000)::bigint * {H} AS "at", count(*) AS n
  FROM raw GROUP BY ALL),
every AS (SELECT source, unnest(range(min("at"), (SELECT max("at") FROM per) + 1, {H})) AS "at" FROM per GROUP BY source),
polls AS (SELECT source, "at", (sum(coalesce(n, 0)) OVER (PARTITION BY source ORDER BY "at"))::bigint AS count
  FROM every LEFT JOIN per USING (source, "at")),
daily AS (SELECT source, "at", (sum(n) OVER (PARTITION BY source, "at" // 86400 ORDER BY "at"))::bigint AS count FROM per)"""

_SYNTH = {x: f"md5(event_id || '|synth-{x}|1')" for x in "abc"}


def _synthetic() -> str:
    n = lambda x, i: hx(x, i)
    product = f"({n('a', 0 + 1)} % {len(chaos.PRODUCTS)} + 1)"
    ids = "[" + ", ".join(f"'{p}'" for p, _ in chaos.PRODUCTS) + "]"
    prices = "[" + ", ".join(str(p) for _, p in chaos.PRODUCTS) + "]"
    return f"""WITH k AS (SELECT *, {", ".join(f"{e} AS {x}" for x, e in _SYNTH.items())} FROM events),
    q AS (SELECT *, {_weighted(chaos.QUANTITY_WEIGHTS, n('a', 2))} AS quantity, {prices}[{product}]::double AS price,
          {ids}[{product}] AS product_id FROM k)
    SELECT 'evt_' || substr(c, 1, 16) AS event_id, strftime(ts, {ISO}) AS event_time, 'checkout' AS event_type,
      'CUS' || lpad(({n('a', 0)} % 5000 + 1)::varchar, 6, '0') AS customer_id,
      'SES' || (100000 + {n('a', 3)} % 900000) AS session_id, 'ORD' || (1000000 + {n('b', 0)} % 9000000) AS order_id,
      product_id, quantity, price AS unit_price, quantity * price AS amount, 'INR' AS currency,
      {_weighted(chaos.METHOD_WEIGHTS, n('b', 1))} AS payment_method,
      {_weighted(chaos.STATUS_WEIGHTS, n('b', 2))} AS payment_status,
      {_weighted(chaos.DEVICE_WEIGHTS, n('b', 3))} AS device, 'IN' AS country, 'web' AS source, 'v1' AS source_version
    FROM q"""


ORACLE |= {
    "count_monitor": over_raw(
        _POLLS + """, d AS (SELECT *, lag(count) OVER w AS last, lag("at") OVER w AS prev FROM polls
          WINDOW w AS (PARTITION BY source ORDER BY "at"))
        SELECT source, "at", count, count - last AS delta, round((count - last) / ("at" - prev), 8) AS rate,
          CASE WHEN last IS NULL THEN 'INITIAL' WHEN count > last THEN 'INCREASING' WHEN count = last THEN 'STABLE'
          ELSE 'DECREASING' END AS status FROM d"""),
    "overall_trend": over_raw(
        _POLLS + """ SELECT source, arg_min(count, "at") AS initial_count, arg_max(count, "at") AS final_count,
        arg_max(count, "at") - arg_min(count, "at") AS growth,
        CASE WHEN arg_max(count, "at") > arg_min(count, "at") OR max(count) > min(count) THEN 'INCREASING'
        ELSE 'NOT INCREASING' END AS trend FROM polls GROUP BY 1"""),
    "interval_rate": over_raw(
        _POLLS + """, d AS (SELECT *, lag(count) OVER w AS last, lag("at") OVER w AS prev FROM daily
          WINDOW w AS (PARTITION BY source ORDER BY "at"))
        SELECT source, "at", count, round(CASE WHEN count >= last THEN count - last WHEN last IS NOT NULL THEN count END
          / ("at" - prev), 8) AS rate FROM d"""),
    "recovery_continuity": over_raw(
        f""", m AS (SELECT {MIDDLE} AS cut), s AS (SELECT source, hour(arrived_at) AS hour,
          count(*) FILTER (epoch_us(arrived_at) < cut * 1000000) AS b,
          count(*) FILTER (epoch_us(arrived_at) < (cut + {H}) * 1000000) AS a,
          count(*) FILTER (epoch_us(arrived_at) < (cut + {12 * H}) * 1000000) AS l FROM raw, m GROUP BY ALL)
        SELECT source, hour, b AS before, a AS after, l AS later, l > a AND a >= b AS continuous FROM s"""),
    "gold_metrics": over_bronze(
        f"""SELECT {stamp("date_trunc('hour', event_time)")} AS hour, product_id, payment_status, count(*) AS events,
        count(DISTINCT customer_id) AS customers, sum(amount)::double AS revenue,
        sum(amount)::double / count(amount) AS avg_amount
        FROM bronze WHERE event_time IS NOT NULL GROUP BY date_trunc('hour', event_time), product_id, payment_status"""),
    "gold_line_revenue":
        f"""SELECT {stamp("date_trunc('hour', l_shipdate)")} AS hour, l_returnflag, l_linestatus, count(*) AS events,
        count(DISTINCT l_suppkey) AS customers, sum(l_extendedprice::decimal(18,2))::double AS revenue,
        sum(l_extendedprice::decimal(18,2))::double / count(*) AS avg_amount
        FROM lineitem GROUP BY date_trunc('hour', l_shipdate), l_returnflag, l_linestatus""",
    "flexible_timestamps":
        f"""SELECT event_id, {stamp('''CASE event_id % 8 WHEN 0 THEN s WHEN 1 THEN s + INTERVAL 250 MILLISECOND
        WHEN 2 THEN s WHEN 3 THEN s - INTERVAL 330 MINUTE WHEN 4 THEN s + INTERVAL 125 MILLISECOND
        WHEN 6 THEN s END''')} AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)""",
    "synthetic_events": _synthetic(),
    "extracted_digits":
        r"""SELECT c_custkey, coalesce(try_cast(regexp_replace(c_name, '\D', '', 'g') AS bigint), 123) AS digits,
        CASE WHEN c_acctbal = 0 THEN -1499.0 ELSE -abs(c_acctbal) END AS negated FROM customer""",
    "observed_contracts": over_daily(
        "SELECT schema_version, field, type, required, array_to_string(enum, ',') AS enum FROM daily"),
    "contract_changes": over_daily(
        """SELECT old_version, new_version, field, change_type, old_value, new_value,
        CASE WHEN breaking THEN 'BREAKING' ELSE 'COMPATIBLE' END AS classification,
        CASE WHEN breaking THEN 'BREAKING' ELSE 'INFO' END AS severity, description,
        row_number() OVER (PARTITION BY old_version, new_version ORDER BY phase, field, step) AS seq FROM change_rows"""),
    "field_lifetimes": over_daily(
        """, ver AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT schema_version AS v FROM daily)),
        d AS (SELECT daily.*, i, lag(i) OVER w AS pi, lag(type) OVER w AS pt, lag(required) OVER w AS pr, lag(enum) OVER w AS pe
          FROM daily JOIN ver ON v = schema_version WINDOW w AS (PARTITION BY field ORDER BY i)),
        k AS (SELECT *, sum(CASE WHEN pi = i - 1 AND pt = type AND pr = required AND pe IS NOT DISTINCT FROM enum THEN 0 ELSE 1 END)
          OVER (PARTITION BY field ORDER BY i)::bigint AS nth FROM d)
        SELECT field, nth, min(schema_version) AS first_version, max(schema_version) AS last_version, count(*) AS versions,
          any_value(type) AS type, any_value(required) AS required, array_to_string(any_value(enum), ',') AS enum FROM k GROUP BY field, nth"""),
    "contract_changes_any": over_raw(", " + DAILY.replace("lag(v) OVER (ORDER BY v) AS old_version, v AS new_version", "a.v AS old_version, b.v AS new_version")
        .replace("FROM (SELECT DISTINCT schema_version AS v FROM daily))", "FROM (SELECT DISTINCT schema_version AS v FROM daily) a "
                 "JOIN (SELECT DISTINCT schema_version AS v FROM daily) b ON a.v < b.v)") +
        """ SELECT old_version, new_version, field, change_type, old_value, new_value,
        CASE WHEN breaking THEN 'BREAKING' ELSE 'COMPATIBLE' END AS classification,
        CASE WHEN breaking THEN 'BREAKING' ELSE 'INFO' END AS severity, description,
        row_number() OVER (PARTITION BY old_version, new_version ORDER BY phase, field, step) AS seq FROM change_rows"""),
    "contract_verdicts": over_daily(
        """, n AS (SELECT p.old_version, p.new_version, count(c.field) AS changes,
          count(*) FILTER (c.breaking) AS breaking FROM pairs p LEFT JOIN change_rows c
          ON p.old_version = c.old_version AND p.new_version = c.new_version GROUP BY ALL)
        SELECT *, CASE WHEN breaking > 0 THEN 'BREAKING' ELSE 'COMPATIBLE' END AS classification,
          CASE WHEN changes = 0 THEN 'Schema ' || old_version || ' and ' || new_version || ' are identical.'
          WHEN breaking = 0 THEN 'Schema evolution from ' || old_version || ' to ' || new_version
            || ' is COMPATIBLE (' || changes || ' change(s) detected).'
          ELSE 'Schema evolution from ' || old_version || ' to ' || new_version || ' is BREAKING (' || breaking
            || ' breaking change(s) detected out of ' || changes || ' total).' END AS summary FROM n"""),
    "contract_breaks_published": over_daily(
        "SELECT old_version, new_version, change_type, field, 'BREAKING' AS classification, description "
        "FROM change_rows WHERE breaking"),
    "contract_drift": over_judged(
        f""", {ENTRIES}, o AS (SELECT schema_version, key, kind, count(*) AS events FROM entries GROUP BY ALL),
        w AS (SELECT * FROM contract WHERE version IN (SELECT schema_version FROM o)),
        j AS (SELECT coalesce(o.schema_version, w.version) AS schema_version, coalesce(o.key, w.field) AS field,
          w.type AS expected, o.kind, coalesce(o.events, 0) AS events
          FROM o FULL JOIN w ON o.schema_version = w.version AND o.key = w.field)
        SELECT *, CASE WHEN schema_version IS NULL OR schema_version NOT IN (SELECT version FROM contract)
          THEN 'UNKNOWN_VERSION' WHEN expected IS NULL THEN 'UNKNOWN_FIELD' WHEN kind IS NULL THEN 'NEVER_SEEN'
          WHEN kind = 'null' THEN 'NULL_VALUE' WHEN kind = expected OR (kind = 'integer' AND expected = 'float')
          OR (kind = 'string' AND expected = 'timestamp') THEN 'OK' ELSE 'TYPE_MISMATCH' END AS status FROM j"""),
    "contract_lint":
        f"""SELECT p_partkey::varchar AS document, CASE WHEN n BETWEEN 1 AND 7 THEN 'amount' END AS field,
        ['BAD_SCHEMA_VERSION', 'UNSUPPORTED_TYPE', 'BAD_TYPE', 'BAD_REQUIRED', 'BAD_ENUM', 'BAD_ENUM_ITEM', '',
         'BAD_DEFINITION', 'NOT_AN_OBJECT', 'INVALID_JSON'][n + 1] AS error
        FROM (SELECT p_partkey, {hx("md5(p_partkey || '|doc')", 0)} % 10 AS n FROM part) WHERE n <> 6""",
    "replayed_events": over_judged(
        """, landed AS (SELECT event_id FROM judged WHERE route = 'valid'),
        good AS (SELECT * FROM judged WHERE route = 'invalid' AND NOT f1 AND (
          len(list_filter(failures, lambda x: x NOT IN ('LATE_EVENT', 'DUPLICATE_EVENT_ID'))) = 0
          OR (fault_mode = 'TYPE_CHANGE' AND t % 3 <> 2) OR (fault_mode = 'SCHEMA_DRIFT' AND t % 3 <> 1)))
        SELECT event_id, "offset", coalesce(value ->> '$.customer_id', value ->> '$.client_id') AS customer_id,
          round(amount_n, 2) AS amount FROM good WHERE event_id NOT IN (SELECT event_id FROM landed)
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, "partition", "offset") = 1"""),
}

LIVE_METRICS = ORACLE.pop("live_metrics")   # of a stream only
ORACLE["stored_by_day"] = ORACLE["bronze_ingest"]
