"""SQL of the derived checkout log and its rule results, for cross-checking.

Written for DuckDB over the given tables, from the rules' definitions rather
than from the Spark plans.
"""

from __future__ import annotations

from tidewarden import model
from tidewarden.operators import chaos
from tidewarden.plans.feed import RATES, SEED
from tidewarden.sources.contracts import checkout_documents


def hx(digest: str, slot: int) -> str:
    return f"('0x' || substr({digest}, {8 * slot + 1}, 8))::bigint"


def one_of(values: list[str], number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({number}) % {len(values)} + 1]"


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

CHECKOUTS = f"""
base AS (
  SELECT *, md5(event_id || '|shape') AS d, md5(event_id || '|clock') AS e FROM events),
numbered AS (
  SELECT *, {hx('d', 0)} AS n0, {hx('d', 1)} AS n1, {hx('d', 2)} AS n2, {hx('d', 3)} AS n3,
         {hx('e', 0)} AS e0, {hx('e', 1)} AS e1 FROM base),
checkouts AS (
  SELECT (user_id % 3)::int AS "partition", event_id AS "offset", ts,
         ts + to_milliseconds(e0 % 2000) AS arrived_at,
         'evt_' || event_id AS event_id, strftime(ts, {ISO}) AS event_time,
         'checkout' AS event_type,
         'CUS' || lpad(user_id::varchar, 6, '0') AS customer_id,
         'SES' || (100000 + n0 % 900000) AS session_id,
         'ORD' || (1000000 + n1 % 9000000) AS order_id,
         'PROD' || lpad((n2 % 10 + 1)::varchar, 3, '0') AS product_id,
         (1 + (n2 // 16) % 5)::int AS quantity,
         value::decimal(18,2) AS unit_price,
         (value::decimal(18,2) * (1 + (n2 // 16) % 5)::int)::decimal(18,2) AS amount,
         'INR' AS currency,
         {one_of(model.PAYMENT_METHODS, 'n3')} AS payment_method,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'SUCCESS' END
           AS payment_status,
         {one_of(['mobile', 'desktop', 'tablet'], 'n3 // 8')} AS device,
         'IN' AS country,
         CASE WHEN user_id % 10 < 5 THEN 'web' WHEN user_id % 10 < 8 THEN 'app' ELSE 'pos' END AS source,
         CASE WHEN e1 % 1000 < 2 THEN 'v9' WHEN e1 % 1000 < 300 THEN 'v2' ELSE 'v1' END AS source_version,
         CASE WHEN e1 % 1000 >= 2 AND e1 % 1000 < 300 THEN 'SAVE' || (e0 % 50) END AS coupon_code
  FROM numbered)"""

NUMERIC = {"quantity", "unit_price", "amount"}
PAYLOAD_FIELDS = [*model.EVENT_FIELDS, "coupon_code"]


def _quoted(expr: str) -> str:
    return f"""'"' || {expr} || '"'"""


def _literal(name: str) -> str:
    return f"{name}::varchar" if name in NUMERIC else _quoted(name)


def _object(fields: dict[str, str]) -> str:
    parts = ", ".join(f"""'"{n}":' || {x}""" for n, x in fields.items())
    return "'{' || concat_ws(',', " + parts + ") || '}'"


def _fires(index: int, rate: float) -> str:
    digest = "ma" if index < 4 else "mb"
    return f"{hx(digest, index % 4)} < {round(rate / 100 * 2 ** 32)}"


def _fired_list() -> str:
    rates = RATES.resolved()
    cases = [f"CASE WHEN {_fires(i, r)} THEN '{m}' END" for i, (m, r) in enumerate(rates.items()) if r > 0]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _mutated() -> str:
    x = {n: _literal(n) for n in PAYLOAD_FIELDS}

    def put(name: str, cond: str, text: str) -> None:
        x[name] = f"(CASE WHEN {cond} THEN {text} ELSE {x[name]} END)"

    for i, n in enumerate(chaos.NULL_TARGETS):
        put(n, f"fault_mode = 'NULL' AND t % 8 = {i}", "'null'")
    for i, n in enumerate(["amount", "unit_price", "quantity"]):
        zero = {"amount": "-1499.00", "unit_price": "-749.50", "quantity": "-2"}[n]
        put(n, f"fault_mode = 'NEGATIVE' AND t % 3 = {i}",
            f"CASE WHEN {n} = 0 THEN '{zero}' ELSE (-abs({n}))::varchar END")
    put("payment_method", "fault_mode = 'INVALID_ENUM' AND t % 2 = 0", _quoted(one_of(chaos.BAD_METHODS, "u")))
    put("payment_status", "fault_mode = 'INVALID_ENUM' AND t % 2 = 1", _quoted(one_of(chaos.BAD_STATUSES, "u")))
    put("quantity", "fault_mode = 'TYPE_CHANGE' AND t % 3 = 0", _quoted("quantity"))
    put("amount", "fault_mode = 'TYPE_CHANGE' AND t % 3 = 1", _quoted("amount"))
    put("customer_id", "fault_mode = 'TYPE_CHANGE' AND t % 3 = 2",
        r"(regexp_replace(customer_id, '\D', '', 'g')::bigint)::varchar")
    put("event_time", "fault_mode = 'TIMESTAMP_DRIFT'", _quoted(
        f"strftime(arrived_at + CASE t % 3 WHEN 0 THEN INTERVAL 2 HOUR WHEN 1 THEN INTERVAL (-30) DAY "
        f"ELSE INTERVAL 15 MINUTE END, {ISO})"))
    put("source_version", "fault_mode = 'SCHEMA_DRIFT'", "'\"v2\"'")
    drift = "fault_mode = 'SCHEMA_DRIFT' AND t % 3 ="
    for i, n in enumerate(chaos.REMOVABLE):
        put(n, f"{drift} 1 AND u % 3 = {i}", "NULL")
    client = x["customer_id"]
    put("customer_id", f"{drift} 2", "NULL")
    x["client_id"] = f"CASE WHEN {drift} 2 THEN {client} END"
    x["customer_segment"] = f"CASE WHEN {drift} 0 THEN {_quoted(one_of(chaos.SEGMENTS, 'u'))} END"
    return _object(x)


def _put(name: str, text: str) -> str:
    return f"""regexp_replace(whole, '"{name}":[^,}}]*', '"{name}":{text}')"""


RAW = CHECKOUTS + f""",
digests AS (
  SELECT *, md5(event_id || '|mode-a|{SEED}') AS ma, md5(event_id || '|mode-b|{SEED}') AS mb,
         md5(event_id || '|pick|{SEED}') AS p FROM checkouts),
fired AS (
  SELECT *, {_fired_list()} AS modes, {hx('p', 0)} AS t, {hx('p', 1)} AS u FROM digests),
labelled AS (
  SELECT *, modes[{hx('mb', 3)} % greatest(len(modes), 1) + 1] AS fault_mode,
         row_number() OVER (PARTITION BY "partition" ORDER BY "offset") AS idx,
         {_object({n: _literal(n) for n in PAYLOAD_FIELDS})} AS clean
  FROM fired),
dirty AS (
  SELECT a.*, CASE WHEN a.fault_mode = 'DUPLICATE' THEN b.clean WHEN a.fault_mode IS NULL THEN a.clean
              ELSE a.mutated END AS whole
  FROM (SELECT *, {_mutated()} AS mutated FROM labelled) a
  LEFT JOIN labelled b ON a.fault_mode = 'DUPLICATE' AND a."partition" = b."partition"
       AND b.idx = a.idx - a.t % least(a.idx, {chaos.HISTORY})),
raw AS (
  SELECT "partition", "offset", arrived_at, source, fault_mode, t,
         CASE {hx("md5(" + '"offset"' + " || '|torn')", 0)} % 300
              WHEN 0 THEN substr(whole, 1, length(whole) - 20) WHEN 1 THEN whole || ' x' WHEN 2 THEN whole || whole
              WHEN 3 THEN {_put('amount', '1e400')} WHEN 4 THEN {_put('amount', '12345678901234567890')}
              WHEN 5 THEN {_put('quantity', '5000000000')} WHEN 6 THEN replace(whole, '"', '''') ELSE whole END AS value
  FROM dirty)"""


def _contract_rows() -> str:
    rows = []
    for version, doc in checkout_documents().items():
        for name, spec in doc["fields"].items():
            enum = "NULL" if "enum" not in spec else str(spec["enum"])
            rows.append(f"('{version}', '{name}', '{spec['type']}', {spec['required']}, {enum})")
    return "contract(version, field, type, required, enum) AS (VALUES " + ", ".join(rows) + ")"


CONTRACT = _contract_rows()

_TS = "try_strptime(substr(value ->> '$.event_time', 1, 19), '%Y-%m-%dT%H:%M:%S')"
_NUM = {n: f"CASE WHEN isfinite(try_cast(value ->> '$.{n}' AS double)) THEN (value ->> '$.{n}')::double END" for n in NUMERIC}
_CASTS = {"amount": "try_cast(try_cast(text AS double) AS decimal(18,2))", "quantity": "try_cast(try_cast(text AS double) AS int)",
          "unit_price": "CASE WHEN isfinite(try_cast(text AS double)) THEN 1 END"}
_IDENT = '"partition", "offset"'

ASSESSED = RAW + ", " + CONTRACT + f""",
docs AS (
  SELECT *, {", ".join(f"value ->> '$.{n}' AS {n if n != 'source' else 'event_source'}" for n in model.EVENT_FIELDS)},
         {_TS} AS event_ts, value ->> '$.source_version' AS schema_version,
         {_NUM['amount']} AS amount_n, {_NUM['unit_price']} AS price_n, {_NUM['quantity']} AS quantity_n
  FROM raw WHERE json_valid(value)),
fieldwise AS (
  SELECT {_IDENT}, c.field, c.type, c.required, c.enum, json_type(value, '$.' || c.field) AS kind,
         value ->> ('$.' || c.field) AS text
  FROM docs JOIN contract c ON c.version = schema_version),
per_event AS (
  SELECT {_IDENT},
    bool_or(required AND kind IS NULL) AS missing,
    bool_or(required AND kind = 'NULL') AS nulls,
    bool_or(kind <> 'NULL' AND CASE
      WHEN type = 'string' THEN kind <> 'VARCHAR'
      WHEN type = 'timestamp' THEN kind <> 'VARCHAR' OR try_strptime(substr(text, 1, 19), '%Y-%m-%dT%H:%M:%S') IS NULL
      WHEN type = 'integer' THEN kind NOT IN ('BIGINT', 'UBIGINT')
      WHEN type = 'float' THEN kind NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') END)
      OR bool_or(kind <> 'NULL' AND CASE field {" ".join(f"WHEN '{n}' THEN {c} IS NULL" for n, c in _CASTS.items())} END) AS mistyped,
    bool_or(kind = 'VARCHAR' AND enum IS NOT NULL AND NOT list_contains(enum, text)) AS bad_enum
  FROM fieldwise GROUP BY ALL),
extra AS (
  SELECT {_IDENT}, bool_or(c.field IS NULL) AS unexpected
  FROM (SELECT {_IDENT}, schema_version, unnest(json_keys(value)) AS key FROM docs) k
  LEFT JOIN contract c ON c.version = k.schema_version AND c.field = k.key GROUP BY ALL),
timing AS (
  SELECT {_IDENT},
    event_ts < max(CASE WHEN event_ts <= arrived_at + INTERVAL 5 MINUTE THEN event_ts END) OVER (
      PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - INTERVAL 5 SECOND AS late,
    event_id IS NOT NULL AND row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, "partition", "offset") > 1 AS again
  FROM docs),
flags AS (
  SELECT r.*, d.* EXCLUDE ("partition", "offset", arrived_at, source, fault_mode, t, value),
    d.value IS NULL AS f0,
    d.value IS NOT NULL AND p."offset" IS NULL AS f1,
    p.missing AS f2, p.nulls AS f3, p.mistyped AS f4,
    p."offset" IS NOT NULL AND x.unexpected AS f5,
    coalesce(amount_n <= 0, false) OR coalesce(price_n <= 0, false) OR coalesce(quantity_n <= 0, false) AS f6,
    abs(amount_n - round(quantity_n * price_n, 2)) >= 0.001 AS f7,
    json_type(d.value, '$.currency') = 'VARCHAR' AND currency NOT IN ('INR', 'USD', 'EUR', 'GBP', 'JPY') AS f8,
    p.bad_enum AS f9,
    event_ts > r.arrived_at + INTERVAL 5 MINUTE AS f10,
    t.late AS f11, t.again AS f12
  FROM raw r LEFT JOIN docs d USING ("partition", "offset")
  LEFT JOIN per_event p USING ("partition", "offset") LEFT JOIN extra x USING ("partition", "offset")
  LEFT JOIN timing t USING ("partition", "offset")),
assessed AS (
  SELECT *, list_filter([{", ".join(f"CASE WHEN f{i} THEN '{code}' END" for i, code in enumerate(model.RULES))}],
                        lambda x: x IS NOT NULL) AS failures,
         {" OR ".join(f"coalesce(f{i}, false)" for i in range(11))} AS bad FROM flags),
judged AS (
  SELECT *, CASE WHEN len(failures) = 0 THEN 'valid' WHEN f0 THEN 'dlq' ELSE 'invalid' END AS route,
         array_to_string(list_sort(failures), ';') AS failure_reason, failures[1] AS failure_type,
         1 - len(failures) / {len(model.RULES)}.0 AS quality_score
  FROM assessed)"""


def over_raw(select: str) -> str:
    return f"WITH {RAW} {select}"


def over_checkouts(select: str) -> str:
    return f"WITH {CHECKOUTS} {select}"


def over_judged(select: str) -> str:
    return f"WITH {ASSESSED} {select}"
