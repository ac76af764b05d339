"""SQL twins of the registered queries, for DuckDB over the same tables.

The digests are computed here from SQL's own sha256, and reduced with HUGEINT
arithmetic, so nothing is shared with the Spark expressions but the key and word lists.
"""

from __future__ import annotations

from veilwright.functions import corpora
from veilwright.functions.text import WHITE_SPACE

from .demo import KEYRING, NOW, REFERENCE_DATE
from .queries import STRATEGY_INPUTS, VARIANTS

_INNER, _OUTER = (pad.hex() for pad in KEYRING.pads())
_BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def hmac(payload: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || {payload})))"


def norm(value: str) -> str:
    return f"nfc_normalize(trim({value}, {_BLANKS}))"


def consistent(strategy: str, value: str) -> str:
    clean = norm(value)
    if strategy == "email":
        clean = f"lower({clean})"
    return hmac(f"encode('{strategy}' || chr(31) || {clean})")


def row_hash(table: str, keys: str, column: str) -> str:
    """`keys` is SQL text that yields the inside of the key's JSON array."""
    return hmac(f"""encode('["demo","{table}","[' || {keys} || ']","{column}"]')""")


def mod(h: str, modulus: int | str) -> str:
    pieces = ", ".join(f"('0x' || substr({h}, {1 + 4 * i}, 4))::HUGEINT" for i in range(16))
    return f"list_reduce([0::HUGEINT, {pieces}], lambda a, x: (a * 65536 + x) % {modulus}::HUGEINT)"


def all_digits(source: str, key: str, hashes: list[str]) -> str:
    """CTEs that end in `places` (key, and each hash as 78 decimal places): long division by 10^9, pass by pass."""
    words = ", ".join(f"('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT AS {h}_w{i}" for h in hashes for i in range(8))
    ctes = [f"d0 AS (SELECT {key}, {words} FROM {source})"]
    for step in range(9):
        parts = []
        for h in hashes:
            for i in range(8):
                here = f"{h}_w{i}" if i == 0 else f"({h}_r{i - 1} * 4294967296 + {h}_w{i})"
                parts += [f"{here} // 1000000000 AS {h}_q{i}", f"{here} % 1000000000 AS {h}_r{i}"]
        kept = "".join(f", {h}_p{k}" for h in hashes for k in range(step))
        names = ", ".join(f"{h}_q{i} AS {h}_w{i}" for h in hashes for i in range(8))
        rests = ", ".join(f"{h}_r7 AS {h}_p{step}" for h in hashes)
        ctes.append(f"e{step} AS (SELECT *, {', '.join(parts)} FROM d{step})")
        ctes.append(f"d{step + 1} AS (SELECT {key}, {names}{kept}, {rests} FROM e{step})")
    texts = ", ".join(
        f"right({' || '.join(f'lpad({h}_p{k}::VARCHAR, 9, chr(48))' for k in reversed(range(9)))}, 78) AS {h}" for h in hashes)
    ctes.append(f"places AS (SELECT {key}, {texts} FROM d9)")
    return ", ".join(ctes)


def digits(h: str, length: int) -> str:
    return f"lpad(({mod(h, 10**length)})::VARCHAR, {length}, '0')"


def piece(h: str, start: int, width: int) -> str:
    return f"('0x' || substr({h}, {start}, {width}))::BIGINT"


def pick(h: str, slot: int, size: int) -> str:
    return f"({piece(h, 1 + 8 * slot, 8)} % {size})"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def word(h: str, slot: int, words) -> str:
    return f"list_extract({sql_list(words)}, ({pick(h, slot, len(words))} + 1)::BIGINT)"


def street(h: str) -> str:
    return (
        f"concat_ws(' ', ({pick(h, 0, 9900)} + 100)::VARCHAR, {word(h, 1, corpora.STREET_STEMS)}, "
        f"{word(h, 2, corpora.STREET_SUFFIXES)})"
    )


def city(h: str, slot: int) -> str:
    return f"{word(h, slot, corpora.CITY_STEMS)} || {word(h, slot + 1, corpora.CITY_ENDINGS)}"


def zip_code(h: str, slot: int) -> str:
    return f"lpad({pick(h, slot, 100000)}::VARCHAR, 5, '0')"


def host(h: str, slot: int) -> str:
    stem = f"lower({word(h, slot, corpora.COMPANY_STEMS)} || {word(h, slot + 1, corpora.COMPANY_FIELDS)})"
    return f"{stem} || '.' || {word(h, slot + 2, corpora.DOMAIN_SUFFIXES)}"


def full_name(h: str) -> str:
    return f"{word(h, 0, corpora.FIRST_NAMES)} || ' ' || {word(h, 1, corpora.LAST_NAMES)}"


def email(h: str, domain: str) -> str:
    local = f"lower({word(h, 0, corpora.FIRST_NAMES)} || '.' || {word(h, 1, corpora.LAST_NAMES)})"
    return f"substr({local}, 1, 51) || '-' || substr({h}, 33, 12) || '@' || {domain}"


def stretched(h: str, blocks: int) -> str:
    more = [f"sha256(unhex({h}) || unhex('{i:08x}'))" for i in range(1, blocks)]
    return " || ".join([h, *more])


def prose(stream: str, sentences: int, limit: int) -> str:
    made = []
    for s in range(sentences):
        values = [piece(stream, 1 + 64 * s + 4 * i, 4) for i in range(13)]
        drawn = ", ".join(
            f"list_extract(lexicon, ({v} % {len(corpora.PROSE_WORDS)} + 1)::BIGINT)" for v in values[1:]
        )
        body = f"array_to_string(list_slice([{drawn}], 1, ({values[0]} % 9 + 4)::BIGINT), ' ')"
        made.append(f"(SELECT upper(substr(b, 1, 1)) || substr(b, 2) || '.' FROM (SELECT {body} AS b))")
    return f"substr({(chr(32) + '||' + chr(32) + chr(39) + ' ' + chr(39) + ' || ').join(made)}, 1, {limit})"


def ipv4(h: str) -> str:
    """The rank-th address of the list of public ranges, written as ranges rather than as shifts."""
    reserved = [
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
        ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
        ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
    ]
    taken = []
    for address, bits in reserved:
        a, b, c, d = (int(x) for x in address.split("."))
        taken.append((a << 24 | b << 16 | c << 8 | d, 1 << (32 - bits)))
    public, start = [], 0
    for base, size in taken:
        if base > start:
            public.append((start, base - start))
        start = base + size
    total = sum(size for _, size in public)
    cases, before = [], 0
    for base, size in public:
        cases.append(f"WHEN rank < {before + size} THEN rank - {before} + {base}")
        before += size
    return (
        f"(SELECT concat_ws('.', a // 16777216, a // 65536 % 256, a // 256 % 256, a % 256) FROM "
        f"(SELECT CASE {' '.join(cases)} END AS a FROM (SELECT {piece(h, 1, 15)} % {total} AS rank)))"
    )


def generated(name: str, h: str, params: dict) -> str:
    lists = {
        "firstName": corpora.FIRST_NAMES, "lastName": corpora.LAST_NAMES, "streetSuffix": corpora.STREET_SUFFIXES,
        "state": corpora.STATES, "country": corpora.COUNTRIES, "companySuffix": corpora.COMPANY_SUFFIXES,
    }
    if name in lists:
        return word(h, 0, lists[name])
    if name == "jobTitle":
        return (
            f"concat_ws(' ', {word(h, 0, corpora.JOB_LEVELS)}, {word(h, 1, corpora.JOB_FIELDS)}, "
            f"{word(h, 2, corpora.JOB_ROLES)})"
        )
    if name == "company":
        return (
            f"concat_ws(' ', {word(h, 0, corpora.COMPANY_STEMS)}, {word(h, 1, corpora.COMPANY_FIELDS)}, "
            f"{word(h, 2, corpora.COMPANY_SUFFIXES)})"
        )
    if name == "address":
        return f"{street(h)} || ', ' || {city(h, 3)} || ', ' || {word(h, 5, corpora.STATES)} || ' ' || {zip_code(h, 6)}"
    if name == "alphanumeric":
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return " || ".join(
            f"substr('{alphabet}', ({piece('stream', 1 + 4 * i, 4)} % 36 + 1)::BIGINT, 1)" for i in range(params["length"])
        )
    days = (REFERENCE_DATE - REFERENCE_DATE.replace(1950, 1, 1)).days
    account = f"({mod(h, 10**18)})"
    return {
        "fullName": lambda: full_name(h),
        "email": lambda: email(h, host(h, 5)),
        "phone": lambda: digits(h, params["digits"]),
        "date": lambda: f"strftime(DATE '1950-01-01' + ({mod(h, days + 1)})::INTEGER, '%Y-%m-%d')",
        "streetAddress": lambda: street(h),
        "city": lambda: city(h, 0),
        "postalCode": lambda: zip_code(h, 0),
        "vatId": lambda: "'DE' || " + digits(h, 9),
        "iban": lambda: (
            f"(SELECT 'DE' || lpad((98 - (n::HUGEINT * 1000000 + 131400) % 97)::VARCHAR, 2, '0') || "
            f"lpad(n::VARCHAR, 18, '0') FROM (SELECT {account} AS n))"
        ),
        "ipv4Public": lambda: ipv4(h),
        "url": lambda: f"'https://www.' || {host(h, 0)} || '/' || {word(h, 3, corpora.PROSE_WORDS)}",
        "uuid": lambda: (
            f"substr({h},1,8) || '-' || substr({h},9,4) || '-4' || substr({h},14,3) || '-' || "
            f"substr('89ab', ({piece(h, 17, 1)} % 4 + 1)::BIGINT, 1) || substr({h},18,3) || '-' || substr({h},21,12)"
        ),
        "digits": lambda: digits(h, params["length"]),
        "number": lambda: f"({mod(h, params['max'] - params['min'] + 1)} + {params['min']})::BIGINT",
        "text": lambda: prose("stream", params["sentences"], params["maxLength"]),
        "hash": lambda: f"to_base64(unhex({h}))",
    }[name]()


def strategy(name: str) -> str:
    table, key, source, params = STRATEGY_INPUTS[name]
    if name == "constant":
        return f"SELECT {key}, 'BRAND' AS value FROM {table}"
    if name == "null":
        return f"SELECT {key}, NULL::VARCHAR AS value FROM {table}"
    if name == "mask":
        return (
            f"SELECT {key}, CASE WHEN length({source}) <= 3 THEN {source} ELSE substr({source}, 1, 2) || "
            f"repeat('#', length({source}) - 3) || right({source}, 1) END AS value FROM {table}"
        )
    if name in ("alphanumeric", "digits", "number", "text"):
        h = row_hash(table, f"{key}::VARCHAR", "value")
    else:
        h = consistent(name, f"{source}::VARCHAR")
    blocks = {"alphanumeric": -(-params.get("length", 0) // 16), "text": params.get("sentences", 0)}.get(name, 1)
    stream = f", {stretched('h', blocks)} AS stream" if blocks > 1 else ", h AS stream"
    lexicon = f", {sql_list(corpora.PROSE_WORDS)} AS lexicon" if name == "text" else ""
    return (
        f"WITH hashed AS (SELECT {key}, {h} AS h FROM {table}), "
        f"streams AS (SELECT {key}, h{stream}{lexicon} FROM hashed) "
        f"SELECT {key}, {generated(name, 'h', params)} AS value FROM streams"
    )


# --- tables derived from the events ---------------------------------------------------------

BACKUPS = """
backups AS (SELECT 'backup-' || event_id AS name, 'c' || user_id AS cluster,
  CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'Running'
    WHEN 'click' THEN 'Starting' ELSE 'Queued' END AS state,
  ts AS created_at,
  CASE WHEN event_type = 'purchase' AND event_id % 11 <> 0 THEN ts + to_seconds(event_id % 7200) END AS completed_at,
  CASE WHEN event_id % 13 = 0 THEN 'pvc/' ELSE 's3://bucket/' END || event_id AS destination,
  CASE WHEN event_id % 5 = 0 THEN 's' || (event_id % 4) ELSE 's' || (event_id % 3) END AS storage,
  'run-' || (event_id % 97) AS run_uid, (event_id % 97) % 3 <> 0 AS settled,
  event_id % 17 = 0 AS has_owner_reference, event_id % 101 = 0 AS is_current FROM events)
"""
LATEST = """
picked AS (SELECT cluster, name AS selected, created_at AS selected_created_at, completed_at AS selected_completed_at,
    destination AS selected_destination
  FROM {source} WHERE state = 'Succeeded' AND completed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY completed_at DESC, created_at DESC, name) = 1)
"""
RUNS = """
runs AS (SELECT 'run-' || event_id AS name, 's' || user_id AS schedule,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'Completed' WHEN event_type = 'error' THEN 'Failed'
    WHEN event_type = 'view' THEN 'Anonymizing' ELSE 'Pending' END AS phase,
  ts AS created_at,
  CASE WHEN event_type IN ('purchase', 'signup', 'error') AND event_id % 9 <> 0
    THEN ts + to_seconds(event_id % 5000) END AS completed_at,
  event_type IN ('purchase', 'signup', 'error') AND event_id % 19 <> 0
    AND (event_id % 3 <> 0 OR event_id % 7 = 0) AS settled,
  event_id, ts FROM events)
"""
LOG_ROWS = """
logs AS (SELECT 'r' || user_id AS run, event_id AS line_no,
  CASE WHEN event_id % 20 = 19 THEN 0 ELSE event_id % 10 END AS kind, event_type,
  event_id % 7 AS done, event_id % 5 + 1 AS total, event_id * 10 AS rows_done, event_id % 3 AS steps FROM events)
"""
POINTER_ROWS = """
pointers AS (SELECT event_id, ts, event_id % 12 AS kind,
  event_id % 12 IN (5, 6, 8, 11) AND event_id % 24 NOT IN (18, 20, 23) AS valid,
  CASE WHEN event_id % 12 IN (5, 6, 7) THEN CASE event_id % 12 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END ELSE 1 END AS version
  FROM events)
"""


def _selected(source: str) -> str:
    return LATEST.format(source=source)


def _fixture_user(n: str) -> str:
    return f"""SELECT {n} AS id, 'user' || {n} || '@example.test' AS email, 'Given' || {n} AS given_name,
      'Family' || {n} AS family_name, DATE '1970-01-01' + (({n} - 1) % 15000)::INTEGER AS birthday,
      'demo-password-' || lpad({n}::VARCHAR, 6, '0') AS password,
      '+1-202-555-01' || lpad((({n} - 1) % 100)::VARCHAR, 2, '0') AS phone,
      TIMESTAMP '2024-01-01' + to_seconds({n}) AS created_at"""


_USERS_TOTAL = "(SELECT count(*) FROM customer)"
_N = "(o_orderkey + 1)"
_USER = f"((o_orderkey) % {_USERS_TOTAL} + 1)"
_ROW_O = row_hash("orders", "o_orderkey::VARCHAR", "o_orderstatus")
_RESUMED = f"""SELECT o_orderkey, {digits('h', 6)} AS o_orderstatus,
  CASE WHEN length(o_orderpriority) <= 1 THEN o_orderpriority
    ELSE left(o_orderpriority, 1) || repeat('*', length(o_orderpriority) - 1) END AS o_orderpriority
  FROM (SELECT o_orderkey, o_orderpriority, {_ROW_O} AS h FROM orders)"""


_UNIQUE_CHECK = """
  SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS rows, 0::BIGINT AS null_keys, count(*) AS duplicate_keys
    FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'conversations', (SELECT count(*) FROM conversations), 0, count(*)
    FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)
  UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 0, count(*)
    FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)"""


def oracles() -> dict[str, str]:
    conv = """conv_id::VARCHAR || ',' || turn::VARCHAR"""
    text_key = """'\\"' || to_base64(encode(c_name)) || '\\",' || c_custkey::VARCHAR"""
    name_key = """'\\"' || to_base64(encode(c_name)) || '\\"'"""
    variant = """CASE WHEN doc_id % 3 = 0 THEN chr(32) || chr(8195) || chr(12288) || chr(9) || text || chr(10) || chr(160)
      WHEN doc_id % 3 = 1 THEN replace(text, 'e', 'e' || chr(769)) ELSE text END"""
    label = KEYRING.retry_label.hex()
    sql = {name: strategy(name) for name in STRATEGY_INPUTS}
    sql |= {
        "value_hash_consistent": f"SELECT doc_id, {consistent('hash', 'text')} AS value FROM documents",
        "value_hash_row": f"SELECT conv_id, turn, {row_hash('conversations', conv, 'value')} AS value FROM conversations",
        "value_hash_row_text_key": f"SELECT c_name, c_custkey, {row_hash('customer', text_key, 'value')} AS value FROM customer",
        "retry_hash": f"""
          WITH b AS (SELECT o_orderkey, (o_orderkey % 8)::INTEGER AS attempt,
            {row_hash('orders', 'o_orderkey::VARCHAR', 'value')} AS h FROM orders)
          SELECT o_orderkey, attempt, CASE WHEN attempt = 0 THEN h ELSE
            {hmac(f"(unhex('{label}') || unhex(h) || unhex(lpad(to_hex(attempt), 2, '0')))")} END AS value FROM b""",
        "digest_mod": f"""
          WITH b AS (SELECT l_orderkey, {hmac('encode(l_orderkey::VARCHAR)')} AS h FROM lineitem)
          SELECT l_orderkey, ({mod('h', 101)})::BIGINT AS mod_101, ({mod('h', 10**9)})::BIGINT AS mod_e9,
            ({mod('h', 10**18)})::BIGINT AS mod_e18, ({mod('h', 2**64)})::VARCHAR AS mod_2_64,
            ({mod('h', 10**33)})::VARCHAR AS mod_e33 FROM b""",
        "digits_33": f"""
          WITH b AS (SELECT o_orderkey, {row_hash('orders', 'o_orderkey::VARCHAR', 'code')} AS c,
            {row_hash('orders', 'o_orderkey::VARCHAR', 'amount')} AS a FROM orders)
          SELECT o_orderkey, {digits('c', 33)} AS code, ({mod('a', 2**62 + 3)})::VARCHAR AS amount FROM b""",
        "digits_78": f"""
          WITH b AS (SELECT o_orderkey, {row_hash('orders', 'o_orderkey::VARCHAR', 'code')} AS c,
            {row_hash('orders', 'o_orderkey::VARCHAR', 'longer')} AS l FROM orders), {all_digits('b', 'o_orderkey', ['c', 'l'])}
          SELECT o_orderkey, c AS code, lpad(l, 90, '0') AS longer FROM places""",
        # Blanks at the ends are cut as pairs of hex digits; the data has none beyond ASCII.
        "hash_binary": f"""
          WITH h AS (SELECT doc_id, substr(hex(encode(text)), 3 + 2 * (doc_id % 7)::INTEGER) AS x FROM documents),
          t AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^(20|09|0A|0B|0C|0D)+', ''), '(20|09|0A|0B|0C|0D)+$', '') AS x FROM h)
          SELECT doc_id, CASE WHEN x = '' THEN '' ELSE {hmac("(encode('hash' || chr(31)) || unhex(x))")} END AS value FROM t""",
        "nfc_trim": f"SELECT doc_id, sha256({norm(variant)}) AS digest FROM documents",
        "apply_table": f"""
          WITH b AS (SELECT *, {consistent('hash', 'c_name')} AS h,
            {row_hash('customer', 'c_custkey::VARCHAR', 'c_acctbal')} AS g FROM customer)
          SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name ELSE left(h, 24) END AS c_name, c_nationkey,
            CASE WHEN c_nationkey = 3 THEN c_acctbal ELSE (({mod('g', 10999)}) - 999)::DOUBLE END AS c_acctbal,
            CASE WHEN c_nationkey = 3 THEN c_mktsegment ELSE 'SEGMENT' END AS c_mktsegment FROM b""",
        "ignore_where": """
          SELECT o_orderkey, o_orderpriority, CASE WHEN NOT (nullif(o_orderpriority, '5-LOW') = '1-URGENT')
            THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
        "on_null": f"""
          WITH v AS (SELECT c_custkey, {VARIANTS} AS value FROM customer)
          SELECT c_custkey, CASE WHEN value = '' THEN '' ELSE {consistent('hash', "coalesce(value, '')")} END AS value,
            CASE WHEN value IS NULL OR value = '' THEN value ELSE 'C' END AS kept FROM v""",
        "on_empty": f"""
          WITH v AS (SELECT c_custkey, {VARIANTS} AS value FROM customer),
          h AS (SELECT c_custkey, value, {consistent('phone', "coalesce(value, '')")} AS h FROM v)
          SELECT c_custkey, CASE WHEN value IS NOT NULL THEN {digits('h', 15)} END AS value,
            CASE WHEN value IS NOT NULL THEN repeat('*', length(value)) END AS kept FROM h""",
        "keyset_predicate": "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (10, 1)",
        "pk_page": """
          SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (7, 2) ORDER BY conv_id, turn LIMIT 50""",
        "email_domain": f"""
          WITH b AS (SELECT c_custkey, {consistent('email', 'upper(c_name)')} AS h FROM customer)
          SELECT c_custkey, {email('h', "'example.com'")} AS value FROM b""",
        "date_datetime": f"""
          WITH b AS (SELECT o_orderkey, {row_hash('orders', 'o_orderkey::VARCHAR', 'o_orderdate')} AS h FROM orders)
          SELECT o_orderkey, TIMESTAMP '2001-02-03' + to_seconds(({mod('h', 1188 * 86400 + 1)})::BIGINT) AS o_orderdate
          FROM b""",
        "date_consistent": f"""
          WITH b AS (SELECT o_orderkey,
            {consistent('date', "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')")} AS h FROM orders)
          SELECT o_orderkey, (DATE '2001-02-03' + ({mod('h', 1189)})::INTEGER)::TIMESTAMP AS o_orderdate FROM b""",
        "digits_composite_key": f"""
          WITH b AS (SELECT conv_id, turn, {row_hash('conversations', conv, 'value')} AS h FROM conversations)
          SELECT conv_id, turn, {digits('h', 30)} AS value FROM b""",
        "number_full_range": f"""
          WITH b AS (SELECT o_orderkey, {row_hash('orders', 'o_orderkey::VARCHAR', 'value')} AS h FROM orders)
          SELECT o_orderkey, (({mod('h', 2**64)}) - 9223372036854775808::HUGEINT)::BIGINT AS value FROM b""",
        "keyless_table": f"""
          WITH b AS (SELECT *, {consistent('hash', 'l_returnflag')} AS f, {consistent('vatId', 'l_linestatus')} AS s
            FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_partkey, left(f, 8) AS l_returnflag, 'DE' || {digits('s', 9)} AS l_linestatus
          FROM b""",
        "output_length": """
          SELECT s AS strategy, w AS declared, w AS shortest, w AS longest, (SELECT count(*) FROM customer) AS n
          FROM (VALUES ('hash', 64), ('digits', 8), ('alphanumeric', 7), ('phone', 15), ('date', 10), ('uuid', 36),
            ('vatId', 11), ('iban', 22)) AS t(s, w)""",
        "link_preserved": "SELECT count(*) AS child_rows, count(*) AS linked_rows FROM orders JOIN customer ON o_custkey = c_custkey",
        "link_preserved_pair": f"""
          WITH b AS (SELECT c_name, {consistent('phone', 'c_name')} AS p,
            {row_hash('orders', 'o_orderkey::VARCHAR', 'o_name')} AS r FROM orders JOIN customer ON o_custkey = c_custkey)
          SELECT 'consistent' AS rule, count(*) AS child_rows, count(*) AS linked_rows FROM b
          UNION ALL SELECT 'row', count(*), count(*) FILTER (WHERE {digits('p', 15)} = {digits('r', 15)}) FROM b""",
        "table_checksum": """
          SELECT count(*) AS rows, sum(('0x' || substr(md5(
            length(o_orderkey::VARCHAR)::VARCHAR || ':' || o_orderkey::VARCHAR ||
            length(o_custkey::VARCHAR)::VARCHAR || ':' || o_custkey::VARCHAR ||
            length(o_orderstatus)::VARCHAR || ':' || o_orderstatus ||
            length(o_orderpriority)::VARCHAR || ':' || o_orderpriority), 1, 15))::BIGINT)::DECIMAL(38, 0) AS checksum
          FROM orders""",
        "checksum_chunks": """
          WITH o AS (
            SELECT 'source' AS side, o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b, o_orderstatus AS c, o_orderpriority AS d FROM orders
            UNION ALL SELECT 'result', o_orderkey::VARCHAR, o_custkey::VARCHAR,
              left(o_orderstatus, 1) || repeat('*', greatest(length(o_orderstatus) - 1, 0)),
              left(o_orderpriority, 1) || repeat('*', greatest(length(o_orderpriority) - 1, 0)) FROM orders)
          SELECT side, count(*) AS rows, sum(('0x' || substr(md5(length(a)::VARCHAR || ':' || a || length(b)::VARCHAR || ':' || b ||
            length(c)::VARCHAR || ':' || c || length(d)::VARCHAR || ':' || d), 1, 15))::BIGINT)::DECIMAL(38, 0) AS checksum,
            true AS equals_one_pass
          FROM o GROUP BY side""",
        "unique_check": _UNIQUE_CHECK,
        "unique_check_words": _UNIQUE_CHECK,
        "preflight": """
          WITH keys AS (
            SELECT 'key_with_duplicates' AS policy, count(*) AS bad FROM
              (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
            UNION ALL SELECT 'composite_key', count(*) FROM
              (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)
            UNION ALL SELECT 'plain', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)),
          outcomes AS (SELECT policy, CASE WHEN bad > 0 THEN 'schema' ELSE 'ok' END AS outcome FROM keys
            UNION ALL SELECT * FROM (VALUES ('missing_column', 'schema'), ('key_as_target', 'schema'),
              ('text_into_number', 'schema'), ('date_into_time', 'ok'), ('late_start', 'policy'),
              ('number_too_wide', 'schema'), ('no_room', 'schema'), ('no_room_for_mail', 'schema'),
              ('null_into_required', 'schema'), ('array_target', 'schema'), ('array_to_null', 'ok'),
              ('missing_table', 'schema')) AS t(policy, outcome))
          SELECT policy, outcome, CASE outcome WHEN 'ok' THEN 0 WHEN 'policy' THEN 10 ELSE 11 END AS exit_code
          FROM outcomes""",
        "value_violation": f"""
          WITH b AS (SELECT c_name, {consistent('email', 'c_name')} AS m,
              {row_hash('customer', 'c_custkey::VARCHAR', 'tiny')} AS t,
              {row_hash('customer', 'c_custkey::VARCHAR', 'money')} AS d FROM customer WHERE c_custkey % 10 <> 0)
          SELECT count(*) AS rows_selected, count(*) FILTER (WHERE length(c_name) > 12) AS bad_short_text,
            count(*) FILTER (WHERE length({email('m', "'mail.example.com'")}) > 40) AS bad_tight_mail,
            count(*) FILTER (WHERE ({mod('t', 321)}) - 20 NOT BETWEEN 0 AND 255) AS bad_tiny,
            count(*) FILTER (WHERE ({mod('d', 2001)}) > 999) AS bad_money, 0::BIGINT AS bad_fits FROM b""",
        "unique_resolve": f"""
          WITH RECURSIVE b AS MATERIALIZED (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS rn,
              {row_hash('customer', 'c_custkey::VARCHAR', 'code')} AS h, {consistent('hash', 'c_mktsegment')} AS s FROM customer),
          tries AS MATERIALIZED (SELECT rn, r, CASE WHEN r = 0 THEN h ELSE
              {hmac(f"(unhex('{label}') || unhex(h) || unhex(lpad(to_hex(r), 2, '0')))")} END AS h FROM b, range(8) AS t(r)),
          wide AS MATERIALIZED (SELECT rn, r, h, w, (10 ** w)::HUGEINT AS m FROM tries,
            (SELECT 5 AS w)),
          options AS MATERIALIZED (SELECT rn, list(lpad(({mod('h', 'm')})::VARCHAR, w::INTEGER, '0') ORDER BY r) AS codes
            FROM wide GROUP BY rn),
          walk AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS taken, 0::BIGINT AS r, NULL::VARCHAR AS code
            UNION ALL SELECT n.rn, list_append(n.taken, n.code), list_position(n.codes, n.code) - 1, n.code FROM (
              SELECT o.rn, w.taken, o.codes, list_filter(o.codes, lambda x: NOT list_contains(w.taken, x))[1] AS code
              FROM walk w JOIN options o ON o.rn = w.rn + 1) n)
          SELECT c_custkey, code, left(CASE WHEN r = 0 THEN s ELSE
              {hmac(f"(unhex('{label}') || unhex(s) || unhex(lpad(to_hex(r), 2, '0')))")} END, 10) AS c_mktsegment
          FROM b JOIN walk USING (rn)""",
        "dry_run": "SELECT 'ok' AS result, 3 AS tables_total, 0::BIGINT AS rows_done, true AS unchanged, count(*) AS n FROM customer",
        "run_totals": """
          WITH c AS (SELECT count(*) AS n FROM customer WHERE NOT (c_nationkey = 3)), o AS (SELECT count(*) AS n FROM orders)
          SELECT t AS table_name, d AS rows_done, 3 AS tables_done, c.n + o.n AS report_rows_done, 'ok' AS result
          FROM c, o, (SELECT 'customer' AS t, (SELECT n FROM c) AS d UNION ALL SELECT 'orders', (SELECT n FROM o)
            UNION ALL SELECT 'supplier', 0)""",
        "truncate_table": """
          SELECT 'before' AS side, 'customer' AS table_name, count(*) AS n FROM customer
          UNION ALL SELECT 'after', 'customer', count(*) FROM customer
          UNION ALL SELECT 'before', 'supplier', count(*) FROM supplier UNION ALL SELECT 'after', 'supplier', 0""",
        "write_table": _RESUMED,
        "null_array": "SELECT vec_id, label, NULL::INTEGER AS n_values FROM embeddings",
        "chunk_resume": _RESUMED,
        "chunk_resume_files": _RESUMED,
        "chunk_resume_packed": _RESUMED,
        "chunk_resume_text_key": f"""
          WITH b AS (SELECT *, {row_hash('orders', name_key, 'c_mktsegment')} AS h FROM customer)
          SELECT c_name, c_custkey, {digits('h', 9)} AS c_mktsegment FROM b""",
        "chunk_resume_composite": f"""
          WITH b AS (SELECT *, {consistent('hash', 'text')} AS t,
            {row_hash('orders', "conv_id::VARCHAR || ',' || turn::VARCHAR", 'role')} AS r FROM conversations)
          SELECT conv_id, turn, {digits('r', 4)} AS role, t AS text FROM b""",
        "chunk_resume_partitioned": """
          SELECT o_orderkey, year(o_orderdate)::INTEGER AS year,
            left(o_orderpriority, 1) || repeat('*', greatest(length(o_orderpriority) - 1, 0)) AS o_orderpriority, 6 AS width
          FROM orders""",
        "run_keeps_layout": """
          SELECT o_orderkey, year(o_orderdate)::INTEGER AS year,
            left(o_orderpriority, 1) || repeat('*', greatest(length(o_orderpriority) - 1, 0)) AS o_orderpriority,
            year(o_orderdate)::INTEGER AS folder, 'orc' AS format FROM orders""",
        "keyless_run": """
          SELECT l_orderkey, l_linenumber, repeat('*', length(l_returnflag)) AS l_returnflag, l_quantity FROM lineitem""",
        "folder_of_orc": """
          SELECT s_suppkey, left(s_name, 3) || repeat('*', greatest(length(s_name) - 3, 0)) AS s_name, s_nationkey, s_acctbal
          FROM supplier""",
        "progress_identity": """
          SELECT t AS name, c::INTEGER AS chunk, 'range' AS rule, 1 AS commits, 1 AS plans, 1 AS hashes
          FROM (VALUES ('customer'), ('orders')) AS x(t), range(3) AS y(c)""",
        "skip_done_chunks": """
          SELECT o_orderkey // 500 AS page, count(*) AS n FROM orders GROUP BY 1
          HAVING count(*) FILTER (WHERE o_orderkey % 1500 = 1) = 0""",
        "step_once": """
          SELECT o_orderpriority, count(*) AS n, true AS first_ran, false AS second_ran FROM orders
          WHERE o_orderstatus <> ';' GROUP BY o_orderpriority""",
        "continue_on_error": "SELECT o_orderstatus, count(*) AS n, 1 AS steps_done FROM orders GROUP BY 1",
        "step_multi": """
          SELECT o_orderstatus AS label, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1
          UNION ALL SELECT 'all;' || o_orderstatus, count(*) FROM orders GROUP BY 1""",
        "apply_policy_stream_events": f"""
          WITH b AS (SELECT event_id, {consistent('hash', 'event_type')} AS e,
            {row_hash('events', 'event_id::VARCHAR', 'value')} AS v FROM events)
          SELECT event_id, left(e, 16) AS event_type, {digits('v', 9)} AS value FROM b""",
        "stream_commits": f"""
          WITH b AS (SELECT event_id, {consistent('hash', 'event_type')} AS e FROM events)
          SELECT event_id, left(e, 16) AS event_type FROM b""",
        "state_counts": f"""
          WITH {BACKUPS} SELECT cluster, count(*) FILTER (WHERE state = 'Succeeded') AS succeeded, count(*) FILTER (WHERE state = 'Failed') AS failed,
            count(*) FILTER (WHERE state = 'Running') AS running, count(*) FILTER (WHERE state = 'Starting') AS starting FROM backups GROUP BY cluster""",
        "candidate_filter": f"""
          WITH {BACKUPS} SELECT cluster, name, state, storage FROM backups WHERE storage IN ('s0', 's3')
            AND (state <> 'Succeeded' OR starts_with(destination, 's3://'))""",
        "latest_succeeded": f"""
          WITH {BACKUPS}, {_selected('backups')},
          counted AS (SELECT cluster, count(*) FILTER (WHERE state = 'Succeeded') AS succeeded,
            count(*) FILTER (WHERE state = 'Succeeded' AND completed_at IS NULL) AS missing_completion FROM backups GROUP BY cluster)
          SELECT cluster, selected, selected_created_at, selected_completed_at, selected_destination, succeeded,
            missing_completion FROM counted LEFT JOIN picked USING (cluster)""",
        "selection_reason": f"""
          WITH {BACKUPS}, usable AS (SELECT * FROM backups WHERE state <> 'Succeeded' OR starts_with(destination, 's3://')),
          {_selected('usable')},
          facts AS (SELECT cluster, selected, count(*) FILTER (WHERE state = 'Failed') AS failed,
            arg_min(name, (-epoch_us(created_at), name)) FILTER (state IN ('Running', 'Starting')) AS busy
            FROM picked JOIN backups b USING (cluster) WHERE b.created_at > selected_created_at GROUP BY ALL)
          SELECT p.cluster, p.selected,
            CASE WHEN failed > 0 THEN 'NewerBackupFailed' WHEN busy IS NOT NULL THEN 'NewerBackupInProgress'
              ELSE 'LatestSucceeded' END AS reason,
            CASE WHEN failed > 0 THEN failed || ' newer backups failed; selected successful backup ' || p.selected
              WHEN busy IS NOT NULL THEN 'newer backup ' || busy || ' is in progress; selected successful backup ' || p.selected
              ELSE 'selected the latest successful backup ' || p.selected END AS message
          FROM picked p LEFT JOIN facts f ON f.cluster = p.cluster""",
        "no_candidate_reason": f"""
          WITH {BACKUPS}, hours AS (SELECT strftime(created_at, '%Y-%m-%d %H') AS hour, * FROM backups),
          current AS (SELECT hour, CASE WHEN right(hour, 1) = '1' THEN 'gone-' || min(name)
            WHEN right(hour, 1) = '2' THEN min(name) END AS current,
            count(*) FILTER (WHERE state = 'Succeeded' AND starts_with(destination, 's3://') AND completed_at IS NOT NULL) AS good,
            count(*) FILTER (WHERE state = 'Succeeded' AND starts_with(destination, 's3://') AND completed_at IS NULL) AS missing
            FROM hours GROUP BY hour)
          SELECT hour, CASE WHEN starts_with(current, 'gone-') THEN 'Dangling' ELSE 'NoCandidate' END AS phase,
            CASE WHEN starts_with(current, 'gone-') THEN 'SelectedBackupDeleted' ELSE 'NoSucceededBackup' END AS reason,
            CASE WHEN starts_with(current, 'gone-') THEN 'the selected backup was deleted and no replacement is available'
              WHEN missing > 0 THEN missing || ' successful backups have no completion timestamp'
              ELSE 'no successful S3 backup with a completion timestamp is available' END AS message
          FROM current WHERE good = 0""",
        "freshness": f"""
          WITH {BACKUPS}, {_selected('backups')}, clusters AS (SELECT DISTINCT cluster FROM backups)
          SELECT cluster, selected, coalesce(selected_completed_at + INTERVAL 36 HOUR > TIMESTAMP '{NOW}', false) AS fresh
          FROM clusters LEFT JOIN picked USING (cluster)""",
        "retention_prune": f"""
          WITH {BACKUPS}, mine AS (SELECT * FROM backups WHERE NOT has_owner_reference),
          complete AS (SELECT cluster FROM mine WHERE state = 'Succeeded' GROUP BY 1 HAVING count(*) = count(completed_at)),
          ranked AS (
            SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY completed_at DESC, created_at DESC, name) AS rank
            FROM mine WHERE state = 'Succeeded' AND cluster IN (SELECT cluster FROM complete)
            UNION ALL
            SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY created_at DESC, name) AS rank
            FROM mine WHERE state = 'Succeeded' AND cluster NOT IN (SELECT cluster FROM complete)),
          doomed AS (SELECT cluster, name, state, is_current, settled FROM ranked WHERE rank > 2
            UNION ALL SELECT cluster, name, state, is_current, settled FROM mine WHERE state = 'Failed'
              AND TIMESTAMP '{NOW}' >= created_at + INTERVAL 24 HOUR)
          SELECT cluster, name, state FROM doomed WHERE settled AND NOT is_current""",
        "settled_owner_filter": f"WITH {BACKUPS} SELECT name, run_uid FROM backups WHERE settled",
        "history_prune": f"""
          WITH {RUNS} SELECT schedule, name, phase FROM runs WHERE settled AND phase IN ('Completed', 'Failed')
          QUALIFY row_number() OVER (PARTITION BY schedule, phase ORDER BY coalesce(completed_at, created_at) DESC, name DESC)
            > CASE phase WHEN 'Completed' THEN 3 ELSE 1 END""",
        "run_status_rollup": f"""
          WITH {RUNS} SELECT schedule, count(*) FILTER (WHERE NOT settled) AS active_count, arg_max(name, (created_at, name)) AS last_run,
            arg_max(phase, (created_at, name)) AS last_phase,
            max(CASE WHEN phase = 'Completed' THEN completed_at END) AS last_success FROM runs GROUP BY schedule""",
        "active_runs": f"WITH {RUNS} SELECT schedule, name FROM runs WHERE NOT settled",
        "phase_distribution": f"WITH {RUNS} SELECT schedule, phase, count(*) AS runs FROM runs GROUP BY ALL",
        "stage_durations": """
          SELECT 'run-' || event_id AS name, 'restore' AS stage, 50 - event_id % 100 AS seconds FROM events
            WHERE event_id % 4 <> 0 AND event_id % 100 <= 50
          UNION ALL SELECT 'run-' || event_id, 'anonymize', event_id % 900 FROM events WHERE event_id % 6 <> 0
          UNION ALL SELECT 'run-' || event_id, 'backup', 440 - event_id % 900 FROM events
            WHERE event_id % 6 <> 0 AND event_id % 2 = 0 AND event_id % 900 <= 440
          UNION ALL SELECT 'run-' || event_id, 'publish', event_id % 30 - 10 FROM events WHERE event_id % 30 >= 10""",
        "condition_transitions": f"""
          WITH {RUNS} SELECT name, 'Complete' AS type, CASE WHEN phase = 'Completed' THEN 'True' ELSE 'False' END AS status,
            (epoch_us(completed_at) // 1000000)::BIGINT AS changed_at_seconds FROM runs WHERE completed_at IS NOT NULL""",
        "read_pointer_doc": f"""
          WITH {POINTER_ROWS} SELECT event_id, valid, version::INTEGER AS version,
            CASE WHEN valid THEN '{{"name":"backup-' || event_id || '","destination":"s3://bucket/backups/' || event_id
              || '","schemaVersion":2' || CASE WHEN kind = 11 THEN '' ELSE
              ',"publishedAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"' END || '}}' END AS json FROM pointers""",
        "pointer_max_age": f"""
          WITH {POINTER_ROWS} SELECT event_id,
            kind = 11 OR (date_trunc('second', ts) >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '{NOW}') AS accepted,
            CASE WHEN kind = 11 THEN 'LegacyPointerAgeUnknown' END AS warning FROM pointers WHERE valid""",
        "read_run_logs": f"""
          WITH {LOG_ROWS}, tail AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 200)
          SELECT run, line_no, CASE kind WHEN 2 THEN 'ok' WHEN 3 THEN 'error' ELSE 'progress' END AS msg,
            CASE kind WHEN 2 THEN 'pre' WHEN 3 THEN 'post' ELSE '' END AS step,
            (CASE WHEN kind > 4 THEN done ELSE 0 END)::INTEGER AS tablesDone,
            CASE WHEN kind > 4 THEN rows_done ELSE 0 END AS rowsDone FROM tail WHERE kind NOT IN (0, 1, 4)""",
        "latest_progress": f"""
          WITH {LOG_ROWS}, tail AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 200)
          SELECT run, done::INTEGER AS tablesDone, total::INTEGER AS tablesTotal, rows_done AS rowsDone,
            steps::INTEGER AS stepsDone, 'demo.' || event_type AS currentTable FROM tail WHERE kind > 4 AND total >= done
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) = 1""",
        "step_outcomes": f"""
          WITH {LOG_ROWS}, tail AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 200)
          SELECT run, line_no, CASE kind WHEN 2 THEN 'runner pre step reported ok'
            ELSE 'runner post step reported error' END AS outcome FROM tail WHERE kind IN (2, 3)
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no) <= 8""",
        "fixture_seed": f"{_fixture_user('(c_custkey + 1)')} FROM customer",
        "fixture_organisations": f"""
          SELECT c_custkey + 1 AS id, c_custkey % {_USERS_TOTAL} + 1 AS user_id,
            'Example Organisation ' || (c_custkey + 1) AS name, 'LLC' AS name_2,
            'DE' || lpad((c_custkey + 1)::VARCHAR, 9, '0') AS vat_id FROM customer""",
        "fixture_join": f"""
          SELECT {_N} AS id, {_USER} AS user_id, 'user' || {_USER} || '@example.test' AS email, 'Given' || {_USER} AS given_name,
            'Family' || {_USER} AS family_name, (10 + (o_orderkey % 10000) / 100)::DECIMAL(12, 2) AS total,
            TIMESTAMP '2024-02-01' + to_seconds({_N}) AS created_at FROM orders""",
        "fixture_addresses": f"""
          SELECT {_N} AS id, {_USER} AS user_id, 'Example Street ' || {_N} AS street,
            lpad((10000 + o_orderkey % 90000)::VARCHAR, 5, '0') AS postal_code,
            'Example City ' || (o_orderkey % 50 + 1) AS city, 'US' AS country,
            '+1-202-555-01' || lpad((({_USER} - 1) % 100)::VARCHAR, 2, '0') AS phone FROM orders""",
        "fixture_links": "SELECT count(*) AS child_rows, count(*) AS linked_rows FROM orders",
    }
    return sql
