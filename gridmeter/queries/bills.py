from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions.scalars import MONTH_NAMES
from gridmeter.operators import bills as b
from gridmeter.queries.registry import Tables, query

# Month names in Devanagari, as some of the composed bills print them.
LOCAL_MONTHS = ["जानेवारी", "फेब्रुवारी", "मार्च", "एप्रिल", "मे", "जून", "जुलै", "ऑगस्ट", "सप्टेंबर", "ऑक्टोबर", "नोव्हेंबर", "डिसेंबर"]


def bill_texts(t: Tables) -> DataFrame:
    """Bill texts composed from orders, in three layouts by order status, with garbled variants by priority."""
    month, urgent = F.month("o_orderdate"), F.col("o_orderpriority")
    year = (F.year("o_orderdate") + 20).cast("string")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    local = F.array(*[F.lit(m) for m in LOCAL_MONTHS])
    word = F.when(urgent == "2-HIGH", F.element_at(local, month)).otherwise(F.element_at(names, month))
    cost = F.format_string("%.2f", "o_totalprice")
    units = (F.dayofyear("o_orderdate") + 50).cast("string")
    mm = F.format_string("%02d", month)
    label = F.when(urgent == "5-LOW", "garbled box ").otherwise("देयक रक्कम रु : ")
    plain = F.concat(
        F.lit("BILL OF SUPPLY FOR THE MONTH OF - "), word, F.lit(" - "), year, F.lit("\n"),
        F.when(urgent == "4-NOT SPECIFIED", F.concat(F.lit("Rs. "), cost, F.lit(" Rs 100.00 Rs 999999.25 Rs 20,50\n"))).otherwise(
            F.concat(F.lit("Bill date: 07-"), mm, F.lit("-"), year, F.lit(" \n"), label, cost, F.lit("\n"))),
        F.lit("History\nJan 1999 55\n"), word, F.lit(" "), year, F.lit(" "), units, F.lit("\n"),
    )
    rounded = F.concat(F.floor("o_totalprice").cast("string"), F.lit(".00"))
    payable = F.when(urgent == "1-URGENT", F.concat(F.lit("Payable 7"), rounded)).when(
        urgent == "5-LOW", F.concat(F.lit("Total current month charges: "), cost)).otherwise(F.concat(F.lit("Payable "), rounded))
    summary = F.concat(
        F.lit("Bill Month | Units Consumed | Current Month Bill\n"), F.upper(F.substring(F.element_at(names, month), 1, 3)), F.lit("-"),
        F.substring(year, 3, 2), F.lit(" "), units, F.lit(" "), cost, F.lit("\n"), payable, F.lit("\n"),
    )
    middle = F.when(urgent == "1-URGENT", "o").otherwise("5")
    sum_units = F.when(urgent == "1-URGENT", units).otherwise((F.dayofyear("o_orderdate") + 55).cast("string"))
    meter = F.concat(
        F.lit("Electricity bill\nIssued 15/"), F.when(urgent == "3-MEDIUM", "19").otherwise(mm), F.lit("/"), year, F.lit("\nAmount "),
        F.replace(cost, F.lit("."), F.lit(",")), F.lit("\n4711 1.00 "), units, F.lit(" "), middle, F.lit(" "), sum_units, F.lit("\n"),
    )
    status = F.col("o_orderstatus")
    text = F.when(status == "F", plain).when(status == "O", summary).otherwise(meter)
    rows = b.evaluate_once(t.table("orders"), "text", text)
    return rows.select(F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("user_id"), "text")


_LOCAL_SQL = "[" + ", ".join(f"'{m}'" for m in LOCAL_MONTHS) + "]"
TEXTS_SQL = f"""
WITH parts AS (SELECT o_orderkey AS bill_id, o_custkey AS user_id, o_orderstatus AS st, o_orderpriority AS pr, month(o_orderdate) AS m,
    CAST(year(o_orderdate) + 20 AS VARCHAR) AS y, printf('%.2f', o_totalprice) AS cost, CAST(dayofyear(o_orderdate) + 50 AS VARCHAR) AS units,
    CAST(dayofyear(o_orderdate) + 55 AS VARCHAR) AS units5, printf('%02d', month(o_orderdate)) AS mm, monthname(o_orderdate) AS name,
    CAST(floor(o_totalprice) AS BIGINT) || '.00' AS rounded,
    CASE WHEN o_orderpriority = '2-HIGH' THEN {_LOCAL_SQL}[month(o_orderdate)] ELSE monthname(o_orderdate) END AS word FROM orders),
texts AS (SELECT bill_id, user_id, st, CASE st
  WHEN 'F' THEN 'BILL OF SUPPLY FOR THE MONTH OF - ' || word || ' - ' || y || chr(10) ||
    CASE WHEN pr = '4-NOT SPECIFIED' THEN 'Rs. ' || cost || ' Rs 100.00 Rs 999999.25 Rs 20,50' || chr(10) ELSE 'Bill date: 07-' || mm || '-' || y || ' ' || chr(10) ||
      CASE WHEN pr = '5-LOW' THEN 'garbled box ' ELSE 'देयक रक्कम रु : ' END || cost || chr(10) END ||
    'History' || chr(10) || 'Jan 1999 55' || chr(10) || word || ' ' || y || ' ' || units || chr(10)
  WHEN 'O' THEN 'Bill Month | Units Consumed | Current Month Bill' || chr(10) || upper(substr(name, 1, 3)) || '-' || substr(y, 3, 2) || ' ' || units || ' ' || cost ||
    chr(10) || CASE WHEN pr = '1-URGENT' THEN 'Payable 7' || rounded WHEN pr = '5-LOW' THEN 'Total current month charges: ' || cost ELSE 'Payable ' || rounded END || chr(10)
  ELSE 'Electricity bill' || chr(10) || 'Issued 15/' || CASE WHEN pr = '3-MEDIUM' THEN '19' ELSE mm END || '/' || y || chr(10) || 'Amount ' || replace(cost, '.', ',') ||
    chr(10) || '4711 1.00 ' || units || ' ' || CASE WHEN pr = '1-URGENT' THEN 'o' ELSE '5' END || ' ' || CASE WHEN pr = '1-URGENT' THEN units ELSE units5 END || chr(10) END AS text
  FROM parts)
"""
_MONTH_CASES = " ".join(f"WHEN regexp_matches(lower(word), '^({p})') THEN {i + 1}" for i, p in enumerate(b.MONTH_PREFIXES))
_MY = r"([\p{L}\p{M}]{2,15})\s*[-–—]?\s*(20[0-9]{2})(?:\s+([0-9]{1,5})(?:[^0-9.]|$))?"
PARSE_SQL = TEXTS_SQL.rstrip() + rf""",
found AS (SELECT bill_id, generate_subscripts(w, 1) AS position, unnest(w) AS word, unnest(y) AS yr, unnest(u) AS un FROM (
  SELECT bill_id, regexp_extract_all(text, '{_MY}', 1) AS w, regexp_extract_all(text, '{_MY}', 2) AS y, regexp_extract_all(text, '{_MY}', 3) AS u FROM texts)),
matches AS (SELECT bill_id, position, CASE {_MONTH_CASES} END AS month, CAST(yr AS INTEGER) AS year, TRY_CAST(nullif(un, '') AS DOUBLE) AS units FROM found),
near AS (SELECT bill_id, text, st, CASE WHEN contains(text, 'MONTH OF') THEN substr(text, instr(text, 'MONTH OF'), 91) END AS tail,
    regexp_extract(text, '([0-9]{{1,2}})[-/.]([0-9]{{2}})[-/.](20[0-9]{{2}})', 2) AS dm, regexp_extract(text, '([0-9]{{1,2}})[-/.]([0-9]{{2}})[-/.](20[0-9]{{2}})', 3) AS dy FROM texts),
labelled AS (SELECT bill_id, text, st, dm, dy, regexp_extract(tail, '{_MY}', 1) AS word, regexp_extract(tail, '{_MY}', 2) AS ly FROM near),
months AS (SELECT bill_id, text, st, CASE WHEN ly <> '' THEN CASE {_MONTH_CASES} END WHEN TRY_CAST(dm AS INTEGER) BETWEEN 1 AND 12 THEN CAST(dm AS INTEGER) END AS month,
    CASE WHEN ly <> '' THEN CAST(ly AS INTEGER) WHEN TRY_CAST(dm AS INTEGER) BETWEEN 1 AND 12 THEN CAST(dy AS INTEGER) END AS year FROM labelled),
costs AS (SELECT bill_id, coalesce(
    TRY_CAST(replace(nullif(regexp_extract(text, 'देयक\s+र\S*\s+र\S*[\s:;|]*([0-9]{{2,7}}[.,][0-9]{{2}})', 1), ''), ',', '.') AS DOUBLE),
    TRY_CAST(replace(nullif(regexp_extract(text, '[0-9]{{1,2}}[-/.][0-9]{{2}}[-/.]20[0-9]{{2}}[\s\S]{{0,500}}?([0-9]{{2,7}}[.,][0-9]{{2}})(?:[^0-9]|$)', 1), ''), ',', '.') AS DOUBLE),
    list_median(list_transform(regexp_extract_all(text, 'Rs\.?\s*([0-9]{{2,7}}[.,][0-9]{{2}})', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)))) AS cost FROM texts),
history AS (SELECT m.bill_id, arg_min(x.units, x.position) AS units FROM months m JOIN matches x ON x.bill_id = m.bill_id AND x.month = m.month AND x.year = m.year
  AND x.units IS NOT NULL GROUP BY 1),
meter AS (SELECT bill_id, CASE WHEN a + a2 = a3 THEN a3 END AS units FROM (SELECT bill_id,
    TRY_CAST(regexp_extract(text, '[0-9]+\s+[0-9]+[.,][0-9]{{2}}\s+([0-9]{{1,5}})\s+([0-9]{{1,5}}|[oO°])\s+([0-9]{{1,5}})', 1) AS DOUBLE) AS a,
    TRY_CAST(regexp_replace(regexp_extract(text, '[0-9]+\s+[0-9]+[.,][0-9]{{2}}\s+([0-9]{{1,5}})\s+([0-9]{{1,5}}|[oO°])\s+([0-9]{{1,5}})', 2), '[oO°]', '0') AS DOUBLE) AS a2,
    TRY_CAST(regexp_extract(text, '[0-9]+\s+[0-9]+[.,][0-9]{{2}}\s+([0-9]{{1,5}})\s+([0-9]{{1,5}}|[oO°])\s+([0-9]{{1,5}})', 3) AS DOUBLE) AS a3 FROM texts)),
summary0 AS (SELECT bill_id, text, regexp_extract(text, '\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-([0-9]{{2}})\s([\s\S]*)', 1) AS mon,
    regexp_extract(text, '\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-([0-9]{{2}})\s([\s\S]*)', 2) AS yy,
    regexp_extract(text, '\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-([0-9]{{2}})(\s[\s\S]*)', 3) AS rest FROM texts WHERE st = 'O'),
summary1 AS (SELECT *, nullif(regexp_extract(rest, '([0-9]{{3,6}})\.00(?:[^0-9]|$)', 1), '') AS pay FROM summary0),
summary AS (SELECT bill_id, CAST(list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], mon) AS INTEGER) AS month, CAST(yy AS INTEGER) + 2000 AS year,
    coalesce(CASE WHEN CAST(pay AS DOUBLE) >= 10000 AND pay LIKE '7%' THEN CAST(substr(pay, 2) AS DOUBLE) ELSE CAST(pay AS DOUBLE) END,
             TRY_CAST(nullif(regexp_extract(text, '(?i)Total\s+current\s+month\s+charges[^0-9]*([0-9]{{3,6}}\.[0-9]{{2}})', 1), '') AS DOUBLE)) AS cost,
    TRY_CAST(nullif(regexp_extract(rest, '^\s*([0-9]{{1,5}})(?:[^0-9.]|$)', 1), '') AS DOUBLE) AS consumption FROM summary1),
plain AS (SELECT m.bill_id, m.month, m.year, c.cost, CASE WHEN m.month IS NOT NULL THEN coalesce(h.units, r.units) END AS consumption
  FROM months m JOIN costs c USING (bill_id) LEFT JOIN history h USING (bill_id) LEFT JOIN meter r USING (bill_id)),
parsed AS (SELECT t.bill_id, t.user_id, coalesce(s.month, p.month) AS month, coalesce(s.year, p.year) AS year, CASE WHEN s.bill_id IS NOT NULL THEN s.cost ELSE p.cost END AS cost,
    CASE WHEN s.bill_id IS NOT NULL THEN s.consumption ELSE p.consumption END AS consumption
  FROM texts t JOIN plain p USING (bill_id) LEFT JOIN summary s USING (bill_id)),
dated AS (SELECT bill_id, user_id, strftime(make_date(2000, month, 1), '%B') || ' ' || year AS bill_date, cost, consumption FROM parsed)
"""


@query("b1_month_year_matches", sql=PARSE_SQL + """
SELECT bill_id, CAST(position - 1 AS INTEGER) AS position, CAST(month AS INTEGER) AS month, year, units FROM matches""")
def _(t: Tables) -> DataFrame:
    rows = bill_texts(t).select("bill_id", F.posexplode(b.month_year_matches(F.col("text"))).alias("position", "_m"))
    return rows.select("bill_id", "position", "_m.month", "_m.year", "_m.units")


@query("b2_bill_month", sql=PARSE_SQL + "SELECT bill_id, CAST(month AS INTEGER) AS month, CAST(year AS INTEGER) AS year FROM months")
def _(t: Tables) -> DataFrame:
    return b.with_bill_month(bill_texts(t), F.col("text"), "_m").select("bill_id", "_m.month", "_m.year")


@query("b3_bill_cost", sql=PARSE_SQL + "SELECT bill_id, cost FROM costs", digits=3, doubles="cost")
def _(t: Tables) -> DataFrame:
    return b.with_bill_cost(bill_texts(t), F.col("text")).select("bill_id", "cost")


@query("b4_bill_units", sql=PARSE_SQL + "SELECT bill_id, consumption FROM plain")
def _(t: Tables) -> DataFrame:
    months = b.with_bill_month(bill_texts(t), F.col("text"))
    return b.with_bill_units(months, F.col("text")).select("bill_id", "consumption")


@query("b5_summary_row", sql=PARSE_SQL + "SELECT bill_id, month, year, cost, consumption FROM summary")
def _(t: Tables) -> DataFrame:
    rows = b.with_summary_row(bill_texts(t), F.col("text"), "_s").filter(F.col("_s").isNotNull())
    return rows.select("bill_id", "_s.month", "_s.year", "_s.cost", "_s.consumption")


@query("b6_parse_bills", sql=PARSE_SQL + "SELECT * FROM dated", digits=3, doubles="cost")
def _(t: Tables) -> DataFrame:
    return b.parse_bills(bill_texts(t)).drop("text")


@query("b6_second_reading", digits=3, doubles="cost", sql=PARSE_SQL + """
SELECT d.bill_id, d.bill_date, d.cost, d.consumption FROM dated d""")
def _(t: Tables) -> DataFrame:
    """The first reading stops before the history lines of the first layout; the second one has the whole text."""
    cut = F.when(F.col("text").contains("History"), F.substring_index("text", "History", 1)).otherwise(F.col("text"))
    texts = bill_texts(t).select("bill_id", cut.alias("text"), F.when(F.col("text").contains("History"), F.col("text")).alias("text_rows"))
    return b.parse_bills(texts, "text", "text_rows").select("bill_id", "bill_date", "cost", "consumption")


@query("b7_bill_rejects", sql=PARSE_SQL + """
SELECT bill_id, concat_ws(', ', CASE WHEN bill_date IS NULL THEN 'bill month' END, CASE WHEN cost IS NULL THEN 'amount' END,
       CASE WHEN consumption IS NULL THEN 'units consumed' END) AS unreadable FROM dated WHERE bill_date IS NULL OR cost IS NULL OR consumption IS NULL""")
def _(t: Tables) -> DataFrame:
    rejected = b.bill_rejects(b.parse_bills(bill_texts(t)))
    return rejected.select("bill_id", F.array_join("unreadable", ", ").alias("unreadable"))
