"""The queries' results stated in SQL (DuckDB), as far as possible not by the same steps:
what the layouts extract is taken from the rules that wrote the pages."""

from __future__ import annotations

from orderflow.functions.text import WHITESPACE

SHY, NBH, EN, EM, BAD = "­", "‑", "–", "—", "�"
FLOAT = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def parse(x: str) -> str:
    s = strip(f"replace(replace(replace({strip(x)}, 'USD', ''), '$', ''), '€', '')")
    d = rf"""(CASE WHEN regexp_matches({s}, '\.\d{{3}},') THEN replace(replace({s}, '.', ''), ',', '.')
      WHEN regexp_matches({s}, ',\d{{3}}\.') THEN replace({s}, ',', '')
      WHEN NOT contains({s}, ',') AND contains({s}, '.') THEN CASE WHEN NOT starts_with({s}, '0.')
        AND regexp_full_match({s}, '[^.]*(\.[^.]{{3}})+') THEN replace({s}, '.', '') ELSE {s} END
      WHEN contains({s}, ',') AND NOT contains({s}, '.') THEN replace({s}, ',', '.') ELSE {s} END)"""
    return f"(CASE WHEN regexp_full_match({d}, '{FLOAT}') THEN TRY_CAST({d} AS DOUBLE) END)"


def numtext(d: str) -> str:
    return f"(CASE WHEN {d} = floor({d}) THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) ELSE CAST({d} AS VARCHAR) END)"


def normal(x: str) -> str:
    return f"coalesce({numtext(parse(x))}, {x})"


def us(cents: str) -> str:
    return f"(format('{{:,}}', CAST({cents} // 100 AS BIGINT)) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def eu(cents: str) -> str:
    return f"translate({us(cents)}, ',.', '.,')"


def styled(cents: str, last: str) -> str:
    return (
        f"CASE style WHEN 0 THEN {eu(cents)} WHEN 1 THEN {us(cents)} WHEN 2 THEN replace({us(cents)}, ',', '') "
        f"ELSE {last} END"
    )


LINES = f"""ol AS (SELECT l_orderkey AS doc_id, l_orderkey * 8 + l_linenumber AS line_seq, l_suppkey, l_shipdate,
  l_extendedprice, l_partkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS key,
  CASE l_suppkey % 13 WHEN 0 THEN 'Wid{BAD}get' WHEN 1 THEN 'Hook{NBH}' WHEN 2 THEN 'a{SHY}b{NBH}'
    ELSE 'Part ' || l_returnflag END AS description,
  CASE style WHEN 0 THEN qty || ',00' WHEN 1 THEN qty || '.00' WHEN 2 THEN qty ELSE ' ' || qty || ' ' END AS quantity,
  {styled('unit', "'USD ' || " + us('unit'))} AS price,
  CASE WHEN l_partkey % 11 = 3 THEN 'Total' ELSE {styled('total', "'€' || " + eu('total'))} END AS amount
  FROM (SELECT *, l_linenumber % 4 AS style, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, cents // CAST(l_quantity AS BIGINT) AS unit,
    CASE WHEN l_linenumber = 5 THEN (cents * 3) // 2 ELSE cents END AS total FROM lineitem))"""
NUMBERS = f"""num AS (SELECT *, {parse('quantity')} AS q, {parse('price')} AS p, {parse('amount')} AS a FROM ol)"""
CLEAN = "clean AS (SELECT * FROM num WHERE NOT (a IS NULL AND amount <> ''))"
TIES = "line_seq, l_suppkey, l_shipdate, l_extendedprice"


def total_flags(source: str, extra: str = "") -> str:
    return f"""SELECT doc_id, key, unnest(['quantity', 'price', 'amount']) AS "column", 'Total Mismatch' AS reason
      FROM {source} WHERE abs(q * p - a) > 1.0 AND abs(q * p - a) > a * 0.01 {extra}"""


def char_flags(source: str) -> str:
    kinds = [(SHY, "Soft Hyphen"), (NBH, "Non-breaking Hyphen"), (BAD, "Replacement Character")]
    return " UNION ALL ".join(
        f"""SELECT doc_id, key, 'description' AS "column", '{name}' AS reason FROM {source}
        WHERE contains(description, '{ch}')""" for ch, name in kinds
    )


def gathered(flags: str) -> str:
    return f"""SELECT doc_id, key, "column", string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons
      FROM ({flags}) GROUP BY ALL"""


def template(prefix: str = "") -> str:
    if prefix:
        item = f"CASE WHEN p_size % 5 = 0 THEN 'Q-' ELSE '{prefix}' END || lpad(CAST(p_partkey AS VARCHAR), 10, '0')"
    else:
        item = "CASE WHEN p_size % 5 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0') ELSE CAST(p_partkey AS VARCHAR) END"
    return f"""tt AS (SELECT p_partkey AS n, {item} AS "Item",
      CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey % 50 + 1 AS DOUBLE) END AS "Qty", p_retailprice AS "Price",
      p_size AS "Pcs/Ctn", p_size * (4 + p_partkey % 7) AS "Pcs/Plt" FROM part)"""


def low_high(q: str, inc: str, dec: str) -> str:
    return f"greatest(0.0::DOUBLE, {q} * (1 - {dec})) AS lo, {q} * (1 + {inc}) AS hi"


FULL = """(CASE WHEN ceil(qi / plt) * plt <= hi THEN CAST(ceil(qi / plt) * plt AS BIGINT)
  WHEN floor(qi / plt) * plt > 0 AND floor(qi / plt) * plt >= lo THEN CAST(floor(qi / plt) * plt AS BIGINT) END)"""
MIXED = """CAST(([t FOR t IN [n * plt + ceil(greatest(0.0::DOUBLE, lo - n * plt) / ctn) * ctn
  FOR n IN range(CAST(floor(hi / plt) AS BIGINT), -1, -1)] IF t >= lo AND t <= hi])[1] AS BIGINT)"""
PLAN = f"(CASE WHEN qi > 0 AND ctn > 0 AND plt > 0 THEN coalesce({FULL}, {MIXED}) ELSE qi END)"


def updates(plan: bool, per_document: bool = False) -> str:
    """CTEs up to upd: all updates of the clean lines with outcome, num and txt."""
    planned = PLAN if plan else "NULL::BIGINT"
    changed = "map_order = 0 AND (planned IS NULL OR planned <> value)" if plan else "false"
    cell = ("doc_id, " if per_document else "") + "n, col_idx"
    return f"""{LINES}, {NUMBERS}, {CLEAN}, {template()},
    flags AS (SELECT DISTINCT doc_id, key, "column" FROM ({total_flags('clean')} UNION ALL {char_flags('clean')})),
    found AS (SELECT c.*, tt.n, tt."Qty" AS old_qty, tt."Price" AS old_price, CAST(c.q AS BIGINT) AS qi, CAST("Pcs/Ctn" AS BIGINT) AS ctn,
      CAST("Pcs/Plt" AS BIGINT) AS plt, {low_high('CAST(c.q AS BIGINT)', '(5.0/100.0::DOUBLE)', '(5.0/100.0::DOUBLE)')}
      FROM clean c LEFT JOIN tt ON c.key = tt."Item"),
    pairs AS (SELECT *, 0 AS map_order, 'quantity' AS source_column, 1 AS col_idx, q AS value, old_qty AS old,
        {planned} AS planned FROM found WHERE n IS NOT NULL
      UNION ALL SELECT *, 1, 'price', 2, p, old_price, NULL::BIGINT FROM found WHERE n IS NOT NULL),
    shown AS (SELECT *, coalesce({changed}, false) AS changed,
      CASE WHEN changed THEN CAST(value AS VARCHAR) || '/' || coalesce(CAST(planned AS VARCHAR), 'N·A') END AS txt,
      CASE WHEN NOT changed THEN value END AS num, CASE WHEN changed THEN 'txt' ELSE 'num' END AS kind,
      coalesce('T' || txt, 'N' || CAST(num AS VARCHAR)) AS cls FROM pairs),
    seq AS (SELECT *, coalesce(lag(cls) OVER (PARTITION BY {cell} ORDER BY {TIES}, map_order),
      'N' || CAST(old AS VARCHAR)) AS before FROM shown),
    upd AS (SELECT s.*, CASE WHEN cls = before THEN 'skipped' WHEN f.key IS NOT NULL THEN 'flagged'
      WHEN changed THEN 'modified' ELSE 'written' END AS outcome
      FROM seq s LEFT JOIN flags f ON s.doc_id = f.doc_id AND s.key = f.key AND s.source_column = f."column")"""


CODES = """codes AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN lpad(part, 9, '0')
    WHEN 2 THEN ' ' || lpad(part, 16, '7') || ' ' WHEN 3 THEN part || '.' WHEN 4 THEN '  ' WHEN 5 THEN 'A' || part
    ELSE part END AS code, CAST(l_partkey * 1000 + l_suppkey AS VARCHAR) AS plain,
  CASE WHEN l_linenumber % 2 = 0 THEN format('{:,}', l_partkey * 1000)
    ELSE replace(format('{:,}', l_partkey * 1000), ',', '.') END AS grouped
  FROM (SELECT *, CAST(l_partkey AS VARCHAR) AS part FROM lineitem))"""


def ident(x: str) -> str:
    return rf"regexp_full_match({strip(x)}, '0\d+|\d{{16,}}')"


def unthousand(x: str) -> str:
    s = strip(x)
    return (
        rf"(CASE WHEN regexp_full_match({s}, '\d+(\.\d{{3}})+') THEN replace({s}, '.', '') "
        rf"WHEN regexp_full_match({s}, '\d+(,\d{{3}})+') THEN replace({s}, ',', '') ELSE {s} END)"
    )


HEADER_CELLS = f"""ht AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey % 5 AS v,
  CAST(o_custkey AS VARCHAR) AS c0, o_orderstatus AS c1, CAST(o_orderkey AS VARCHAR) AS c2,
  {eu('cents')} AS c3, {us('cents')} AS c4, o_orderpriority AS c5
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))"""

PACKING = """pk AS (SELECT *, CAST(q AS BIGINT) AS qi,
    CASE WHEN inc = '5%' THEN 5.0::DOUBLE / 100.0 WHEN inc = '0.15' THEN 0.15::DOUBLE ELSE 10.0::DOUBLE / q END AS ir,
    CASE WHEN dec = '2 %' THEN 2.0::DOUBLE / 100.0 WHEN dec = '5%' THEN 5.0::DOUBLE / 100.0
      WHEN dec = '0.15' THEN 0.15::DOUBLE ELSE 10.0::DOUBLE / q END AS dr,
    greatest(0.0::DOUBLE, qi * (1 - dr)) AS lo, qi * (1 + ir) AS hi
  FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_suppkey, l_partkey, l_quantity * 10 + l_linenumber AS q,
    CAST(p_size AS BIGINT) AS ctn, CAST(p_size * (4 + p_partkey % 7) AS BIGINT) AS plt,
    CASE l_linenumber % 3 WHEN 0 THEN '5%' WHEN 1 THEN '0.15' ELSE '10' END AS inc,
    CASE WHEN l_suppkey % 2 = 0 THEN '2 %' ELSE inc END AS dec
    FROM lineitem JOIN part ON l_partkey = p_partkey))"""
PACK = "doc_id, l_linenumber, l_suppkey, l_partkey, q"

ITEMS = f"""items AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus, o_orderpriority, i,
    o_custkey + i * 7 AS part, 1 + (o_orderkey * 7 + i * 13) % 50 AS qty, 50 + (o_orderkey * 31 + i * 17) % 500000 AS unit,
    CASE WHEN o_orderkey % 10 = 0 THEN 2 * qty * unit ELSE qty * unit END AS total,
    strftime(o_orderdate, '%d/%m/%Y') AS date, CAST(1 + (i - 1) // 2 AS INTEGER) AS page
  FROM (SELECT *, unnest(range(1, 2 + o_orderkey % 3)) AS i FROM orders)),
columns_ AS (SELECT doc_id, o_orderkey, o_orderpriority, i, page, CAST(100 + 20 * i AS INTEGER) AS line_key,
    page::BIGINT * 4294967296 + 100 + 20 * i AS line_seq, 'P-' || lpad(CAST(part AS VARCHAR), 10, '0') AS key,
    'Part ' || o_orderstatus AS description, qty || ',00' AS quantity, {eu('unit')} AS price,
    CASE WHEN o_orderkey % 17 = 5 AND i = 1 THEN 'Total' WHEN o_orderkey % 19 = 7 AND i = 1 THEN 'N/A' ELSE {eu('total')} END AS amount, date AS delivery, qty
  FROM items),
columns_num AS (SELECT *, {parse('quantity')} AS q, {parse('price')} AS p, {parse('amount')} AS a
  FROM (SELECT * REPLACE (nullif(amount, 'N/A') AS amount) FROM columns_))"""
MARKER = f"""marker_ AS (SELECT doc_id, page, i, CAST(100 + 40 * i AS INTEGER) AS line_key, 'OP' || part AS key,
    qty || ',00' AS quantity, 'YP ' || o_orderstatus AS other_part_no,
    CASE WHEN o_orderkey % 4 <> 0 THEN date ELSE '' END AS delivery,
    CASE WHEN o_orderkey % 5 <> 0 THEN {eu('unit')} ELSE '' END AS bucket_price,
    CASE WHEN o_orderkey % 5 <> 0 THEN {eu('unit')} ELSE 'STK' END AS price,
    CASE WHEN o_orderkey % 7 = 0 OR i = 2 THEN '' ELSE 'Hinge ' || o_orderpriority END AS description, qty FROM items)"""
TAIL = f"""tail_ AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1 AS page, CAST(1000 + doc_id * 10 + i AS VARCHAR) AS key,
    CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE 'Hook{NBH}steel  ' || lang END AS head_rest,
    CASE WHEN (doc_id + i) % 3 <> 0 THEN 'Hook-steel  ' || lang WHEN doc_id % 2 = 0 THEN 'Brand: ' || source ELSE '' END AS description,
    CAST(10 * i AS VARCHAR) AS master_pack, '5' AS inner_pack, replace(format('{{:,}}', qty), ',', '.') AS quantity,
    {eu('unit')} AS price, {eu('total')} AS amount, '01-05-26' AS delivery, qty
  FROM (SELECT *, unnest(range(1, 1 + doc_id % 4)) AS i, 1 + (doc_id * 7 + i) % 2000 AS qty,
    50 + (doc_id * 31 + i * 17) % 50000 AS unit,
    CASE WHEN doc_id % 10 = 1 THEN 2 * qty * unit ELSE qty * unit END AS total FROM documents)),
tail_num AS (SELECT *, {parse('quantity')} AS q, {parse('price')} AS p, {parse('amount')} AS a FROM tail_)"""
WORDS = """doc_lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS text,
    unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
words AS (SELECT doc_id, CAST(line // 50 AS INTEGER) AS page, line, unnest(ws) AS text, unnest(range(len(ws))) AS pos
  FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM doc_lines)),
placed AS (SELECT *, CAST(line % 50 * 12 + CASE WHEN pos % 5 >= 3 THEN 3 ELSE 0 END AS INTEGER) AS line_key FROM words)"""

RUN = f"""{ITEMS}, {template('P-')},
clean AS (SELECT * FROM columns_num WHERE a IS NOT NULL OR amount IS NULL),
flagged AS (SELECT doc_id, key FROM clean WHERE abs(q * p - a) > 1.0 AND abs(q * p - a) > a * 0.01),
found AS (SELECT c.*, tt.n, tt."Qty" AS old_qty, CAST(q AS BIGINT) AS qi, CAST("Pcs/Ctn" AS BIGINT) AS ctn, CAST("Pcs/Plt" AS BIGINT) AS plt,
  {low_high('CAST(q AS BIGINT)', '(5.0/100.0::DOUBLE)', '(5.0/100.0::DOUBLE)')} FROM clean c LEFT JOIN tt ON c.key = tt."Item"),
planned AS (SELECT *, CASE WHEN n IS NOT NULL THEN {PLAN} END AS planned,
  n IS NOT NULL AND (planned IS NULL OR planned <> q) AS changed FROM found),
run AS (SELECT r.*, CASE WHEN n IS NULL THEN 'unmatched' WHEN NOT changed AND old_qty IS NOT DISTINCT FROM q THEN 'skipped'
    WHEN f.key IS NOT NULL THEN 'flagged' WHEN changed THEN 'modified' ELSE 'written' END AS outcome,
  CASE WHEN n IS NULL THEN NULL WHEN changed THEN 'txt' ELSE 'num' END AS new_kind,
  CASE WHEN n IS NOT NULL AND NOT changed THEN q END AS new_num,
  CASE WHEN changed THEN CAST(q AS VARCHAR) || '/' || coalesce(CAST(planned AS VARCHAR), 'N·A') END AS new_txt
  FROM planned r LEFT JOIN flagged f ON r.doc_id = f.doc_id AND r.key = f.key)"""

GRID = """grid AS (
  SELECT * FROM (VALUES (0::BIGINT, 0, 'txt', NULL::DOUBLE, 'p_name'), (0, 1, 'txt', NULL, 'p_brand'), (0, 2, 'txt', NULL, 'p_type'),
    (0, 3, 'txt', NULL, 'p_size'), (0, 4, 'txt', NULL, 'p_retailprice')) h(row_idx, col_idx, kind, num, txt)
  UNION ALL SELECT p_partkey + 1, 0, 'txt', NULL, p_name FROM part UNION ALL SELECT p_partkey + 1, 1, 'txt', NULL, p_brand FROM part
  UNION ALL SELECT p_partkey + 1, 2, 'txt', NULL, p_type FROM part UNION ALL SELECT p_partkey + 1, 3, 'num', CAST(p_size AS DOUBLE), NULL FROM part
  UNION ALL SELECT p_partkey + 1, 4, 'num', p_retailprice, NULL FROM part),
valued AS (SELECT *, coalesce(txt, CASE WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END) AS value FROM grid)"""

STATS = """count(*) AS total_csv_rows, count(n) AS rows_matched, count(*) - count(n) AS rows_not_found, 0::BIGINT AS rows_blank_key"""
SHOWN = "kind AS new_kind, num AS new_num, txt AS new_txt"

BY_TEMPLATE = f"""{ITEMS}, {template('P-')},
        clean AS (SELECT *, o_orderpriority AS name FROM columns_num WHERE a IS NOT NULL OR amount IS NULL),
        flagged AS (SELECT DISTINCT doc_id, key FROM clean WHERE abs(q * p - a) > 1.0 AND abs(q * p - a) > a * 0.01),
        found AS (SELECT c.*, f.key IS NOT NULL AS marked, CASE WHEN name < '2' THEN 'full' ELSE 'moved' END AS template, tt.n,
          tt."Qty" AS old_qty, tt."Price" AS old_price, CAST(q AS BIGINT) AS qi, CAST("Pcs/Ctn" AS BIGINT) AS ctn, CAST("Pcs/Plt" AS BIGINT) AS plt,
          CASE WHEN name < '2' THEN 15.0::DOUBLE / 100.0 ELSE 5.0::DOUBLE / 100.0 END AS ir, 5.0::DOUBLE / 100.0 AS dr, {low_high('qi', 'ir', 'dr')}
          FROM clean c LEFT JOIN tt ON c.key = tt."Item" LEFT JOIN flagged f ON c.doc_id = f.doc_id AND c.key = f.key WHERE name < '3'),
        planned AS (SELECT *, CASE WHEN n IS NOT NULL AND template = 'full' THEN {PLAN} END AS planned,
          n IS NOT NULL AND template = 'full' AND (planned IS NULL OR planned <> q) AS changed FROM found),
        upd AS (SELECT doc_id, template, key, CASE WHEN template = 'full' THEN n + 1 ELSE 2 * n + 8 END AS row_idx,
          CASE WHEN n IS NULL THEN NULL WHEN template = 'full' THEN 1 ELSE 3 END AS col_idx, CASE WHEN n IS NOT NULL THEN 'quantity' END AS source_column, planned,
          CASE WHEN n IS NULL THEN 'unmatched' WHEN NOT changed AND old_qty IS NOT DISTINCT FROM q THEN 'skipped'
            WHEN marked THEN 'flagged' WHEN changed THEN 'modified' ELSE 'written' END AS outcome,
          CASE WHEN n IS NULL THEN NULL WHEN changed THEN 'txt' ELSE 'num' END AS new_kind,
          CASE WHEN n IS NOT NULL AND NOT changed THEN q END AS new_num,
          CASE WHEN changed THEN CAST(q AS VARCHAR) || '/' || coalesce(CAST(planned AS VARCHAR), 'N·A') END AS new_txt FROM planned
        UNION ALL SELECT doc_id, template, key, CASE WHEN template = 'full' THEN n + 1 ELSE 2 * n + 8 END, CASE WHEN template = 'full' THEN 2 ELSE 0 END, 'price', NULL,
          CASE WHEN old_price = p THEN 'skipped' WHEN marked THEN 'flagged' ELSE 'written' END, 'num', p, NULL FROM planned WHERE n IS NOT NULL)"""


ORACLES = {
    "parse_localized_numbers": f"""WITH {LINES} SELECT doc_id, line_seq, key, quantity, price, amount,
        {parse('quantity')} AS quantity_num, {parse('price')} AS price_num, {parse('amount')} AS amount_num FROM ol""",
    "normalize_numeric_text": f"""WITH {LINES} SELECT doc_id, line_seq, key, {normal('quantity')} AS quantity,
        {normal('price')} AS price, {normal('amount')} AS amount FROM ol""",
    "identifier_profile": f"WITH {CODES} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) FILTER ({ident(c)}) AS identifiers,
        count(*) FILTER ({ident(c)}) / count(*) AS share FROM codes""" for c in ("code", "plain", "grouped")),
    "typed_coercion": f"""WITH {CODES} SELECT doc_id, plain, CASE WHEN is_num THEN 'num' ELSE 'txt' END AS kind,
        CASE WHEN is_num THEN number END AS num, CASE WHEN s = '' THEN '' WHEN id THEN s WHEN NOT is_num THEN code END AS txt,
        id AS force_text FROM (SELECT *, {strip('code')} AS s, {ident('code')} AS id, {parse('code')} AS number,
          s <> '' AND NOT id AND number IS NOT NULL AS is_num FROM codes)""",
    "strip_thousands": f"""WITH {CODES} SELECT doc_id, {unthousand('code')} AS code, {unthousand('plain')} AS plain,
        {unthousand('grouped')} AS grouped FROM codes""",
    "canonical_keys": f"""WITH {CODES} SELECT doc_id, plain, {numtext('d')} AS from_number, {strip('code')} AS from_text
        FROM (SELECT *, CAST(plain AS DOUBLE) / CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 1 END AS d FROM codes)""",
    "null_markers": f"""WITH {LINES} SELECT doc_id, line_seq, key,
        CASE WHEN l_partkey % 7 <> 0 THEN quantity END AS quantity FROM ol""",
    "clean_text": f"""SELECT doc_id, {strip(f"replace(replace(t, '{SHY}', ''), '{NBH}', '-')")} AS a,
        replace(replace(t, '{SHY}', '-'), '{NBH}', '-') AS b,
        replace(replace(replace(replace(t, '{SHY}', '-'), '{NBH}', '-'), '{EN}', '-'), '{EM}', '-') AS c
        FROM (SELECT doc_id, translate(text, 'eat', '{SHY}{NBH}{EN}') AS t FROM documents)""",
    "select_key_and_columns": "SELECT l_orderkey, l_quantity, l_linenumber, 'nope' AS missing FROM lineitem",
    "conform_columns": "SELECT s_name, s_suppkey, '' AS s_phone FROM supplier",
    "classify_layouts": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
        ['columns_es', 'columns', 'marker', 'tail', 'marker'][o_orderkey % 5 + 1] AS layout, o_orderkey % 5 IN (1, 4) AS columns_ok,
        CASE o_orderkey % 5 WHEN 0 THEN 'Cantidad' ELSE 'Quantity' END AS qty_column,
        ['Precio', 'Price', 'Price USD', 'Unit price', 'Price USD'][o_orderkey % 5 + 1] AS price_column,
        ['Importe', 'Amount', NULL, 'Amount', NULL][o_orderkey % 5 + 1] AS amount_column FROM orders""",
    "rename_by_position": f"""WITH {HEADER_CELLS} SELECT doc_id, c0 AS key, quantity, c3 AS price, c4 AS amount, c5 AS delivery,
        {parse('quantity')} AS quantity_num, {parse('c4')} AS amount_num
        FROM (SELECT *, CASE v WHEN 2 THEN c1 WHEN 4 THEN c0 ELSE c2 END AS quantity FROM ht)""",
    "conform_mixed_tables": f"""WITH {HEADER_CELLS} SELECT doc_id, layout, key, quantity, price, amount, other_part_no, {parse('price')} AS price_num
        FROM (SELECT *, ['columns_es', 'columns', 'marker', 'tail', 'marker'][v + 1] AS layout, c0 AS key,
          [c2, c2, c1, c4, c0][v + 1] AS quantity, [c3, c3, c3, c5, c3][v + 1] AS price, [c4, c4, NULL, NULL, NULL][v + 1] AS amount,
          [NULL, NULL, c2, NULL, c1][v + 1] AS other_part_no FROM ht)""",
    "invalid_numeric_split": f"""WITH {LINES}, {NUMBERS} SELECT doc_id, line_seq, key, amount,
        CASE WHEN a IS NULL THEN 'amount=' || amount ELSE '' END AS reasons FROM num""",
    "line_total_mismatch": f"WITH {LINES}, {NUMBERS} {total_flags('num')}",
    "suspicious_chars": f"WITH {LINES} {char_flags('ol')}",
    "flag_union": f"WITH {LINES}, {NUMBERS} {gathered(total_flags('num') + ' UNION ALL ' + char_flags('num'))}",
    "flag_counts": f"""WITH {LINES}, {NUMBERS} SELECT doc_id, reason, count(*) AS cells FROM (SELECT DISTINCT doc_id, reason, key, "column"
        FROM ({total_flags('num')} UNION ALL {char_flags('num')})) GROUP BY ALL""",
    "validate": f"WITH {LINES}, {NUMBERS}, {CLEAN} {gathered(total_flags('clean') + ' UNION ALL ' + char_flags('clean'))}",
    "validation_report": f"""WITH {LINES}, {NUMBERS}, {CLEAN},
        flags AS (SELECT doc_id, count(DISTINCT (key, "column")) AS n FROM ({total_flags('clean')} UNION ALL {char_flags('clean')}) GROUP BY 1)
        SELECT num.doc_id, count(*) AS rows_in, count(*) FILTER (a IS NULL) AS rows_removed, coalesce(any_value(flags.n), 0) AS cells_flagged
        FROM num LEFT JOIN flags ON num.doc_id = flags.doc_id GROUP BY 1""",
    "report_tables": f"""WITH {LINES}, {NUMBERS}, files AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS v, o_orderkey % 97 = 0 AS twice FROM orders),
        rows_ AS (SELECT *, doc_id % 5 AS v, doc_id % 5 IN (0, 1, 3) AND a IS NULL AS bad FROM num WHERE doc_id % 97 <> 0),
        kept AS (SELECT * FROM rows_ WHERE NOT bad),
        marks AS (SELECT doc_id, count(DISTINCT (key, "column")) AS n FROM ({total_flags('kept', 'AND v IN (0, 1, 3)')} UNION ALL {char_flags('kept')}) GROUP BY 1),
        counts AS (SELECT doc_id, count(*) AS rows_in, count(*) FILTER (bad) AS rows_removed FROM rows_ GROUP BY 1)
        SELECT f.doc_id, CASE WHEN twice THEN 'columns' ELSE ['columns_es', 'columns', 'marker', 'tail', 'tail'][v + 1] END AS layout,
          NOT twice AND v IN (0, 1, 3) AS columns_ok, CASE WHEN twice THEN 'duplicate_header' WHEN c.doc_id IS NULL THEN 'no_rows' ELSE 'ok' END AS status,
          coalesce(rows_in, 0) AS rows_in, coalesce(rows_removed, 0) AS rows_removed, coalesce(n, 0) AS cells_flagged
        FROM files f LEFT JOIN counts c ON f.doc_id = c.doc_id LEFT JOIN marks m ON f.doc_id = m.doc_id""",
    "grid_cells": f"WITH {GRID} SELECT * FROM grid",
    "first_row_index": f"WITH {GRID} SELECT value, min(row_idx) AS row_idx FROM valued GROUP BY 1",
    "first_row_index_by_column": f"WITH {GRID} SELECT value, min(row_idx) AS row_idx FROM valued WHERE col_idx = 0 GROUP BY 1",
    "first_col_index": f"WITH {GRID} SELECT lower(value) AS name, arg_min(col_idx, row_idx * 100 + col_idx) AS col_idx FROM valued GROUP BY 1",
    "cell_updates": f"""WITH {LINES}, {NUMBERS} SELECT line_seq, l_suppkey, key, 0 AS map_order, 'quantity' AS source_column,
        'qty' AS target_column, 1 AS col_idx, 'num' AS kind, q AS num, NULL::VARCHAR AS txt FROM num
        UNION ALL SELECT line_seq, l_suppkey, key, 1, 'price', 'Price', 2, 'num', p, NULL FROM num""",
    "lookup_merge": f"""WITH {LINES}, {template()} SELECT doc_id, line_seq, l_suppkey, key, n AS row_idx FROM ol JOIN tt ON key = "Item" """,
    "unmatched_keys": f"""WITH {LINES}, {template()} SELECT key, count(*) AS "lines" FROM ol
        WHERE NOT EXISTS (SELECT 1 FROM tt WHERE "Item" = key) GROUP BY 1""",
    "detect_change": f"""WITH {LINES}, {template()} SELECT line_seq, l_suppkey, key, number AS num, number = tt."Price" AS unchanged
        FROM (SELECT *, (9000 + l_partkey % 1000 + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) / 10 AS number FROM ol)
        JOIN tt ON key = "Item" """,
    "sequence_updates": f"""WITH {updates(False)} SELECT line_seq, l_suppkey, key, n AS row_idx, col_idx, map_order,
        outcome = 'skipped' AS skipped FROM upd""",
    "classify_outcome": f"""WITH {updates(True)} SELECT line_seq, l_suppkey, key, source_column, outcome, planned, {SHOWN} FROM upd
        UNION ALL SELECT line_seq, l_suppkey, key, NULL, 'unmatched', NULL, NULL, NULL, NULL FROM found WHERE n IS NULL""",
    "apply_updates": f"""WITH {updates(False)},
        fin AS (SELECT n, arg_max(num, ({TIES}, map_order)) FILTER (col_idx = 1) AS qv, arg_max(num, ({TIES}, map_order)) FILTER (col_idx = 2) AS pv
          FROM upd WHERE outcome <> 'skipped' GROUP BY 1)
        SELECT tt.n, "Item", {numtext('coalesce(qv, "Qty")')} AS "Qty", {numtext('coalesce(pv, "Price")')} AS "Price", "Pcs/Ctn", "Pcs/Plt"
        FROM tt LEFT JOIN fin ON tt.n = fin.n""",
    "apply_updates_to_grid": f"""WITH {updates(False)},
        fin AS (SELECT n + 1 AS row_idx, col_idx, arg_max(num, ({TIES}, map_order)) AS v, CASE WHEN bool_or(outcome = 'flagged') THEN 'flagged' ELSE 'written' END AS outcome
          FROM upd WHERE outcome <> 'skipped' GROUP BY ALL),
        cells AS (SELECT * FROM (VALUES (0::BIGINT, 0, 'txt', NULL::DOUBLE, 'Item'), (0, 1, 'txt', NULL, 'Qty'), (0, 2, 'txt', NULL, 'Price')) h(row_idx, col_idx, kind, num, txt)
          UNION ALL SELECT n + 1, 0, 'txt', NULL, "Item" FROM tt UNION ALL SELECT n + 1, 1, 'num', "Qty", NULL FROM tt WHERE "Qty" IS NOT NULL
          UNION ALL SELECT n + 1, 2, 'num', "Price", NULL FROM tt)
        SELECT coalesce(c.row_idx, f.row_idx) AS row_idx, coalesce(c.col_idx, f.col_idx) AS col_idx, coalesce(c.kind, 'num') AS kind,
          coalesce(f.v, c.num) AS num, c.txt, f.outcome FROM cells c FULL JOIN fin f ON c.row_idx = f.row_idx AND c.col_idx = f.col_idx""",
    "apply_updates_per_document": f"""WITH {updates(False, True)},
        fin AS (SELECT doc_id, n, arg_max(num, ({TIES}, map_order)) FILTER (col_idx = 1) AS qv, arg_max(num, ({TIES}, map_order)) FILTER (col_idx = 2) AS pv
          FROM upd WHERE outcome <> 'skipped' GROUP BY 1, 2)
        SELECT fin.doc_id, tt.n, "Item", {numtext('coalesce(qv, "Qty")')} AS "Qty", {numtext('coalesce(pv, "Price")')} AS "Price", "Pcs/Ctn", "Pcs/Plt"
        FROM tt JOIN fin ON tt.n = fin.n""",
    "change_log_per_document": f"""WITH {updates(False, True)} SELECT doc_id, line_seq, l_suppkey, key, source_column, outcome, {SHOWN}
        FROM upd WHERE outcome <> 'skipped'""",
    "merge_stats": f"""WITH {updates(True)}, per AS (SELECT doc_id, {STATS} FROM found GROUP BY 1),
        marks AS (SELECT doc_id, count(*) FILTER (outcome = 'modified') AS red, count(*) FILTER (outcome = 'flagged') AS yellow,
          count(*) FILTER (outcome = 'skipped') AS skipped FROM upd GROUP BY 1)
        SELECT per.*, coalesce(red, 0) AS red_cells, coalesce(yellow, 0) AS yellow_cells, coalesce(skipped, 0) AS skipped_cells,
          'Nope' AS missing_columns, false AS qty_recalc_disabled FROM per LEFT JOIN marks ON per.doc_id = marks.doc_id""",
    "tolerance_ratios": f"WITH {PACKING} SELECT {PACK}, ir AS inc_ratio, dr AS dec_ratio FROM pk",
    "packing_full": f"WITH {PACKING} SELECT {PACK}, {FULL} AS pieces FROM pk",
    "packing_mixed": f"WITH {PACKING} SELECT {PACK}, {MIXED} AS pieces FROM pk",
    "plan_packing_table": f"WITH {PACKING} SELECT {PACK}, {PLAN} AS planned FROM pk",
    "packing_display": f"""WITH {PACKING} SELECT {PACK}, CASE WHEN changed THEN 'txt' ELSE 'num' END AS new_kind,
        CASE WHEN NOT changed THEN q END AS new_num,
        CASE WHEN changed THEN CAST(q AS VARCHAR) || '/' || coalesce(CAST(planned AS VARCHAR), 'N·A') END AS new_txt, changed AS new_force_text
        FROM (SELECT *, {PLAN} AS planned, planned IS NULL OR planned <> q AS changed FROM pk)""",
    "text_lines": """SELECT doc_id, 1 AS page, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
        unnest(string_split(text, chr(10))) AS text FROM documents WHERE text <> ''""",
    "cluster_lines": f"WITH {WORDS} SELECT doc_id, page, line * 1000000 + pos AS word_seq, line_key FROM placed",
    "assemble_lines": f"""WITH {WORDS} SELECT doc_id, page, line_key, string_agg(text, ' ' ORDER BY pos) AS line_text FROM placed GROUP BY ALL""",
    "detect_headers": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey % 3 < 2 AS detected,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Artículo|Descripcion|Cantidad|Precio|Importe|Entrega'
          ELSE 'Item|Description|Quantity|Price|Amount|Delivery' END AS headers FROM orders""",
    "bucket_lines": f"WITH {ITEMS} SELECT doc_id, page, line_key, key, description, quantity, price, amount, delivery FROM columns_",
    "order_lines_columns": f"""WITH {ITEMS} SELECT doc_id, page, key, description, {normal('quantity')} AS quantity, {normal('price')} AS price,
        {normal('amount')} AS amount, delivery, q AS quantity_num, p AS price_num, a AS amount_num, line_seq FROM columns_num""",
    "marker_lines": f"WITH {ITEMS}, {MARKER} SELECT doc_id, page, line_key, key, quantity, other_part_no, delivery, bucket_price, price FROM marker_",
    "next_line_description": f"""WITH {ITEMS}, {MARKER} SELECT doc_id, page, line_key, description FROM marker_
        UNION ALL SELECT doc_id, page, line_key + 15, '' FROM marker_""",
    "order_lines_marker": f"""WITH {ITEMS}, {MARKER} SELECT doc_id, page, key, description, {normal('quantity')} AS quantity,
        {normal('price')} AS price, delivery, other_part_no, {parse('price')} AS price_num FROM marker_""",
    "bucket_lines_by_table": f"""WITH {ITEMS}, {MARKER}
        SELECT 'columns' AS layout, doc_id, page, line_key, key, description, quantity, price, amount, delivery, '' AS other_part_no FROM columns_
        UNION ALL SELECT 'marker', doc_id, page, line_key, key, description, quantity, price, '', delivery, other_part_no FROM marker_""",
    "order_lines_by_table": f"""WITH {ITEMS}, {MARKER}
        SELECT 'columns' AS layout, doc_id, page, line_seq, key, description, {normal('quantity')} AS quantity, {normal('price')} AS price, {normal('amount')} AS amount,
          delivery, '' AS other_part_no, q AS quantity_num, p AS price_num, a AS amount_num FROM columns_num
        UNION ALL SELECT 'marker', doc_id, page, page::BIGINT * 4294967296 + line_key, key, description, {normal('quantity')}, {normal('price')}, '', delivery, other_part_no,
          {parse('quantity')}, {parse('price')}, NULL FROM marker_""",
    "tail_regex_lines": f"""WITH {TAIL} SELECT doc_id, page, key, head_rest, master_pack, inner_pack, quantity, price, amount, delivery FROM tail_""",
    "lookahead_description": f"WITH {TAIL} SELECT doc_id, key, description FROM tail_",
    "order_lines_tail": f"""WITH {TAIL} SELECT doc_id, key, description, master_pack, inner_pack, {normal('quantity')} AS quantity,
        {normal('price')} AS price, {normal('amount')} AS amount, delivery, q AS quantity_num, p AS price_num, a AS amount_num FROM tail_num""",
    "order_lines_all_layouts": f"""WITH {ITEMS}, {MARKER}, {TAIL}
        SELECT 'columns' AS layout, count(*) AS "rows", CAST(sum(qty) AS BIGINT) AS pieces, count(a) AS amounts FROM columns_num
        UNION ALL SELECT 'marker', count(*), CAST(sum(qty) AS BIGINT), 0 FROM marker_
        UNION ALL SELECT 'tail', count(*), CAST(sum(qty) AS BIGINT), count(a) FROM tail_num""",
    "extraction_outcome": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 4 AS "rows",
        CASE WHEN doc_id % 4 > 0 THEN 'ok' ELSE 'no_rows' END AS status FROM documents""",
    "extraction_counts": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(1 + (o_orderkey % 3) // 2 AS BIGINT) AS pages,
        1 + o_orderkey % 3 AS "rows" FROM orders""",
    "extract_only": f"WITH {TAIL} {gathered(total_flags('tail_num'))}",
    "full_run": f"WITH {RUN} SELECT doc_id, line_seq, key, planned, outcome, new_kind, new_num, new_txt FROM run",
    "run_stats": f"""WITH {RUN}, ex AS (SELECT doc_id, count(*) AS rows_extracted, count(*) FILTER (a IS NULL AND amount IS NOT NULL) AS rows_removed FROM columns_num GROUP BY 1),
        fl AS (SELECT doc_id, 3 * count(*) AS cells_flagged FROM flagged GROUP BY 1),
        mg AS (SELECT doc_id, {STATS}, count(*) FILTER (outcome = 'modified') AS red_cells, count(*) FILTER (outcome = 'flagged') AS yellow_cells,
          count(*) FILTER (outcome = 'skipped') AS skipped_cells FROM run GROUP BY 1)
        SELECT ex.*, coalesce(cells_flagged, 0) AS cells_flagged, coalesce(total_csv_rows, 0) AS total_csv_rows, coalesce(rows_matched, 0) AS rows_matched,
          coalesce(rows_not_found, 0) AS rows_not_found, coalesce(rows_blank_key, 0) AS rows_blank_key, coalesce(red_cells, 0) AS red_cells,
          coalesce(yellow_cells, 0) AS yellow_cells, coalesce(skipped_cells, 0) AS skipped_cells,
          '' AS missing_columns, false AS qty_recalc_disabled
        FROM ex LEFT JOIN fl ON ex.doc_id = fl.doc_id LEFT JOIN mg ON ex.doc_id = mg.doc_id""",
    "profile_status": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
        CASE WHEN o_orderpriority < '4' THEN 'ok' WHEN o_orderpriority < '5' THEN 'unknown_layout' ELSE 'unknown_profile' END AS status FROM orders""",
    "profile_runs": f"""WITH {ITEMS}, {template('P-')},
        clean AS (SELECT *, o_orderpriority AS name FROM columns_num WHERE a IS NOT NULL OR amount IS NULL),
        flagged AS (SELECT DISTINCT doc_id, key FROM clean WHERE abs(q * p - a) > 1.0 AND abs(q * p - a) > a * 0.01),
        found AS (SELECT c.*, f.key IS NOT NULL AS marked, tt.n, tt."Qty" AS old_qty, tt."Price" AS old_price, CAST(q AS BIGINT) AS qi,
          CAST("Pcs/Ctn" AS BIGINT) AS ctn, CAST("Pcs/Plt" AS BIGINT) AS plt,
          CASE WHEN name < '2' THEN 15.0::DOUBLE / 100.0 ELSE 5.0::DOUBLE / 100.0 END AS ir,
          CASE WHEN name < '3' THEN 5.0::DOUBLE / 100.0 ELSE 0.0::DOUBLE END AS dr, {low_high('qi', 'ir', 'dr')}
          FROM clean c LEFT JOIN tt ON c.key = tt."Item" LEFT JOIN flagged f ON c.doc_id = f.doc_id AND c.key = f.key WHERE name < '4'),
        planned AS (SELECT *, CASE WHEN n IS NOT NULL THEN {PLAN} END AS planned, n IS NOT NULL AND (planned IS NULL OR planned <> q) AS changed FROM found)
        SELECT doc_id, key, CASE WHEN n IS NOT NULL THEN 'quantity' END AS source_column, planned,
          CASE WHEN n IS NULL THEN 'unmatched' WHEN NOT changed AND old_qty IS NOT DISTINCT FROM q THEN 'skipped'
            WHEN marked THEN 'flagged' WHEN changed THEN 'modified' ELSE 'written' END AS outcome,
          CASE WHEN n IS NULL THEN NULL WHEN changed THEN 'txt' ELSE 'num' END AS new_kind,
          CASE WHEN n IS NOT NULL AND NOT changed THEN q END AS new_num,
          CASE WHEN changed THEN CAST(q AS VARCHAR) || '/' || coalesce(CAST(planned AS VARCHAR), 'N·A') END AS new_txt FROM planned
        UNION ALL SELECT doc_id, key, 'price', NULL, CASE WHEN old_price = p THEN 'skipped' WHEN marked THEN 'flagged' ELSE 'written' END, 'num', p, NULL
          FROM planned WHERE n IS NOT NULL AND name >= '2'""",
    "profile_runs_by_template": f"""WITH {BY_TEMPLATE} SELECT doc_id, template, key, row_idx, col_idx, source_column, planned, outcome, new_kind, new_num, new_txt FROM upd""",
    "profile_status_by_template": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
        CASE WHEN o_orderpriority < '3' THEN 'ok' WHEN o_orderpriority < '5' THEN 'unknown_template' ELSE 'unknown_profile' END AS status FROM orders""",
    "apply_updates_by_template": f"""WITH {BY_TEMPLATE},
        cells AS (SELECT 'full' AS template, n + 1 AS row_idx, 0 AS col_idx, 'txt' AS kind, NULL::DOUBLE AS num, "Item" AS txt FROM tt
          UNION ALL SELECT 'full', n + 1, 1, 'num', "Qty", NULL FROM tt WHERE "Qty" IS NOT NULL UNION ALL SELECT 'full', n + 1, 2, 'num', "Price", NULL FROM tt
          UNION ALL SELECT 'full', n + 1, 3, 'num', "Pcs/Ctn", NULL FROM tt
          UNION ALL SELECT 'moved', 2 * n + 8, 0, 'num', "Price", NULL FROM tt UNION ALL SELECT 'moved', 2 * n + 8, 1, 'txt', NULL, "Item" FROM tt
          UNION ALL SELECT 'moved', 2 * n + 8, 2, 'num', "Pcs/Plt", NULL FROM tt UNION ALL SELECT 'moved', 2 * n + 8, 3, 'num', "Qty", NULL FROM tt WHERE "Qty" IS NOT NULL),
        final AS (SELECT * FROM upd WHERE outcome IN ('flagged', 'modified', 'written')),
        touched AS (SELECT DISTINCT doc_id, template, row_idx FROM final), own AS (SELECT * FROM touched JOIN cells USING (template, row_idx))
        SELECT doc_id, template, row_idx, col_idx, coalesce(f.new_kind, o.kind) AS kind, CASE WHEN f.new_kind IS NULL THEN o.num ELSE f.new_num END AS num,
          CASE WHEN f.new_kind IS NULL THEN o.txt ELSE f.new_txt END AS txt, outcome FROM own o FULL JOIN final f USING (doc_id, template, row_idx, col_idx)""",
}
