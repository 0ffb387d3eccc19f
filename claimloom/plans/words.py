"""Queries over single functions on names, strengths, dates, forms and identifiers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import dates, forms, sig, text, units
from claimloom.plans.claims import plain, view

#: Notations made from numbers of the table of parts, so that both engines begin from the same texts.
LINES = """
SELECT p_partkey AS item, concat(CASE p_partkey % 5 WHEN 0 THEN 'Tab. ' WHEN 1 THEN 'CAP ' WHEN 2 THEN 'syp ' WHEN 3 THEN 'T. ' ELSE '' END, p_name, CASE p_partkey % 3 WHEN 0 THEN '-plus' ELSE '' END,
    ' ', CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN 'MG' WHEN 1 THEN ' mg' WHEN 2 THEN '' ELSE 'ml' END, CASE p_partkey % 6 WHEN 0 THEN ' BD × 5/7' WHEN 1 THEN ' od x10d' WHEN 2 THEN ' (SOS)' ELSE '' END) AS raw,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name, p_partkey % 7 > 1 AND p_partkey % 11 > 3 AS resolved,
  CASE p_partkey % 13 WHEN 0 THEN 'Tabs' WHEN 1 THEN ' CAP' WHEN 2 THEN 'susp' WHEN 3 THEN 'Service' WHEN 4 THEN 'strip of 10' WHEN 5 THEN '' WHEN 6 THEN 'vial' WHEN 7 THEN 'Powder' WHEN 8 THEN 'consumable' WHEN 9 THEN 'lozenge' END AS form,
  concat(CASE p_partkey % 9 WHEN 0 THEN 'home delivery ' WHEN 1 THEN 'Hand SOAP ' WHEN 2 THEN 'Protein-X ' ELSE '' END, p_name) AS printed,
  concat(CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'mg' WHEN 2 THEN ' gm' ELSE 'MG' END, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('+', CAST(p_partkey % 90 + 1 AS STRING), '.5 mg') ELSE concat(' / ', CAST(p_partkey % 50 + 1 AS STRING), 'mcg') END) AS strength
FROM {part}"""
PEOPLE = """
SELECT c_custkey AS person, CASE c_custkey % 8 WHEN 0 THEN 'Mr. Asha Rao' WHEN 1 THEN 'ASHA  Devi Rao' WHEN 2 THEN 'Dr. Ishan' WHEN 3 THEN 'ishan p. k. roy' WHEN 4 THEN 'Mrs.' WHEN 5 THEN NULL WHEN 6 THEN ' Roy ' ELSE concat('Emp ', c_name) END AS written,
  CASE c_custkey % 5 WHEN 0 THEN 'Rao, Asha' WHEN 1 THEN 'Ishan Roy' WHEN 2 THEN 'Baby Devi' WHEN 3 THEN NULL ELSE c_name END AS other,
  CASE c_custkey % 6 WHEN 0 THEN 'inr' WHEN 1 THEN ' usd ' WHEN 2 THEN 'Rs.' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'EURO' END AS money,
  concat(CAST(c_custkey AS STRING), ' Main Road, ', CASE c_custkey % 7 WHEN 0 THEN 'Pune, MAHARASHTRA' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Delhi and Haryana border' WHEN 3 THEN 'Kochi' WHEN 4 THEN 'goa' WHEN 5 THEN 'Hyderabad, Telangana' ELSE 'West Bengal' END) AS address,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE 'LIC/1' END AS licence, c_acctbal AS balance
FROM {customer}"""
NUMBERS = """
SELECT s_suppkey AS seller, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN lower(number) WHEN 3 THEN concat(substr(number, 1, 2), '-', substr(number, 3), ' ') WHEN 4 THEN concat(number, '9') ELSE number END AS printed
FROM (SELECT s_suppkey, concat(lpad(CAST(s_suppkey % 45 AS STRING), 2, '0'), 'AAPFU', lpad(CAST(s_suppkey * 7 % 10000 AS STRING), 4, '0'), 'F1Z', substr('V0A9K', CAST(s_suppkey % 5 + 1 AS INT), 1)) AS number FROM {supplier}) n"""
DATES = """
SELECT o_orderkey AS item, CASE o_orderkey % 12 WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(d, '/', m, '/', y) WHEN 2 THEN concat(d, '.', m, '.', substr(y, 3)) WHEN 3 THEN concat(d, ' Mar ', y) WHEN 4 THEN concat('August ', d, ' ', y)
  WHEN 5 THEN concat(d, '-oct-', y) WHEN 6 THEN concat(d, '/', m, '/', y, ' 8:12:00AM') WHEN 7 THEN concat('31/2/', y) WHEN 8 THEN concat(m, '/', d, '/1', substr(y, 3)) WHEN 9 THEN 'soon' WHEN 10 THEN ' ' ELSE concat(y, '/', m, '/', d) END AS raw,
  CASE o_orderkey % 9 WHEN 0 THEN concat(m, '/', y) WHEN 1 THEN concat('JUL ', substr(y, 3)) WHEN 2 THEN concat(y, '-', m) WHEN 3 THEN concat(substr(y, 3), '-Sept') WHEN 4 THEN concat('13/', y) WHEN 5 THEN concat(m, '-1', substr(y, 3)) WHEN 6 THEN '-' WHEN 7 THEN concat(d, '/', m, '/', y) ELSE 'best before' END AS expiry
FROM (SELECT o_orderkey, CAST(year(o_orderdate) + 20 AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS d FROM {orders}) x"""
PRICES = """
SELECT l_orderkey AS item, l_linenumber AS line, l_quantity AS quantity, CAST(l_extendedprice AS DOUBLE) AS total, l_extendedprice / (l_quantity * CASE l_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 1.01 END) AS price,
  CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 10 END AS per_pack, CASE l_partkey % 7 WHEN 0 THEN 'unit' WHEN 1 THEN 'pack' END AS declared, l_discount * 20 - 0.5 AS share,
  l_tax AS x0, l_discount AS y0, l_tax + l_quantity / 60 - 0.1 AS x1, l_discount * 3 AS y1 FROM {lineitem}"""


def drug_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, LINES)
    return rows.select("item", text.clean_drug_string(F.col("raw")).alias("cleaned"), text.label(F.col("name"), F.col("raw")).alias("label"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = view(spark, sf_dir, LINES), F.col
    return rows.select("item", forms.normalise_form(c("form")).alias("form"), forms.classify_line(c("resolved"), c("printed"), c("raw"), c("form")).alias("class"), forms.outside_medicine(c("resolved"), c("form")).alias("outside"))


def strength_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, LINES).select("item", F.posexplode(units.parse_strengths(F.col("strength"))).alias("k", "s"))
    return rows.select("item", "k", F.round("s.value", 4).alias("value"), "s.unit")


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = view(spark, sf_dir, PEOPLE), F.col
    split = rows.select("person", text.same_person(c("written"), c("other")).alias("same"), text.split_name(c("written")).alias("n"), text.currency(c("money")).alias("currency"), text.state_in_address(c("address")).alias("state"), text.licence_printed(c("licence")).alias("licensed"))
    return split.select("person", "same", "n.first", "n.middle", "n.last", "currency", "state", "licensed")


def gstin_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = view(spark, sf_dir, NUMBERS), F.col("printed")
    return rows.select("seller", text.cleaned_gstin(c).alias("number"), text.gstin_problem(c).alias("problem"), text.gstin_valid(c).alias("valid"), text.state_of_code(text.cleaned_gstin(c)).alias("state"))


def date_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, DATES).select("item", dates.date_parts(F.col("raw")).alias("parts"))
    read = {order: dates.by_order(F.col("parts"), order) for order in ("dmy", "mdy", "strict")}
    return rows.select("item", *(read[o]["value"].alias(o) for o in read), *(read[o]["status"].alias(f"{o}_status") for o in ("dmy", "strict")))


def expiry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dates.resolve_expiry(F.col("expiry"))
    return view(spark, sf_dir, DATES).select("item", told["value"].alias("expiry"), told["status"].alias("status"))


def price_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    basis = units.units_basis(c("declared"), c("quantity"), c("price"), c("total"), c("per_pack"))
    rows = view(spark, sf_dir, PRICES).select("item", "line", basis.alias("b"), units.clamp_unit(c("share")).alias("share"), units.valid_box(F.array("x0", "y0", "x1", "y1")).alias("box_ok"), units.bar_segments(c("total"), c("quantity") * 900, c("price")).alias("bar"))
    return rows.groupBy("b.basis", "b.method", "box_ok").agg(F.count("*").alias("n"), F.round(F.sum("share"), 2).alias("share"), F.round(F.sum("bar.used"), 2).alias("used"), F.round(F.sum("bar.claim"), 2).alias("claim"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (drug_strings, line_classes, strength_parts, person_names, gstin_problems, date_resolve, expiry_resolve, price_basis)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _cases(pairs, of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


_FORM = f"coalesce({_cases(forms.FORMS.items(), 'f')}, f)"
_DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_MONTH = "(list_position(" + _list(m[:3] for m in dates.MONTHS) + ", substr(lower({w}), 1, 3)))"
_WORD = "lower({w}) IN (" + ", ".join(f"'{m}', '{m[:3]}'" for m in dates.MONTHS) + ")"
_DAY = "CAST(try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d') AS DATE)"
_YEAR = "CASE WHEN {y} >= 1900 THEN {y} WHEN {y} < 100 THEN {y} + 2000 END"
#: Dates: the three written forms first, then three numbers by what the order can be.
_DATES = f"""d AS ({plain(DATES)}), t AS (SELECT *, trim(regexp_replace(trim(raw), '[\\s,]+\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?\\s*([AaPp]\\.?[Mm]\\.?)?\\s*$', '')) AS x FROM d),
  p AS (SELECT *, regexp_extract(x, '^(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})$', ['y', 'm', 'd']) AS iso, regexp_extract(x, '^(\\d{{1,2}})[- ]([A-Za-z]+)[- ](\\d{{4}})$', ['d', 'm', 'y']) AS w, regexp_extract(x, '^([A-Za-z]+) (\\d{{1,2}}) (\\d{{4}})$', ['m', 'd', 'y']) AS a,
    list_transform(regexp_extract_all(x, '\\d+'), lambda g: CAST(g AS INT)) AS n FROM t),
  k AS (SELECT *, CASE WHEN iso.y <> '' THEN {_DAY.format(y="TRY_CAST(iso.y AS INT)", m="TRY_CAST(iso.m AS INT)", d="TRY_CAST(iso.d AS INT)")} WHEN w.y <> '' AND {_WORD.format(w="w.m")} THEN {_DAY.format(y="TRY_CAST(w.y AS INT)", m=_MONTH.format(w="w.m"), d="TRY_CAST(w.d AS INT)")}
      WHEN a.y <> '' AND {_WORD.format(w="a.m")} THEN {_DAY.format(y="TRY_CAST(a.y AS INT)", m=_MONTH.format(w="a.m"), d="TRY_CAST(a.d AS INT)")} END AS named, len(n) = 3 AND NOT regexp_matches(x, '[A-Za-z]') AS three, {_YEAR.format(y="n[3]")} AS y FROM p),
  v AS (SELECT *, n[1] <= 12 AND n[2] <= 12 AS either, {_DAY.format(y="y", m="n[2]", d="n[1]")} AS df, {_DAY.format(y="y", m="n[1]", d="n[2]")} AS mf FROM k)"""
_TOLD = "CASE WHEN x = '' OR x IS NULL THEN NULL WHEN named IS NOT NULL THEN 'read' WHEN NOT three THEN 'unreadable' WHEN y IS NULL THEN 'year' WHEN either THEN {either} WHEN n[1] > 12 AND n[2] <= 12 THEN CASE WHEN df IS NULL THEN 'invalid' ELSE 'read' END WHEN n[2] > 12 AND n[1] <= 12 THEN CASE WHEN mf IS NULL THEN 'invalid' ELSE 'read' END ELSE 'unreadable' END"
_VALUE = "CASE WHEN named IS NOT NULL THEN named WHEN three AND y IS NOT NULL AND either THEN {either} WHEN three AND n[1] > 12 AND n[2] <= 12 THEN df WHEN three AND n[2] > 12 AND n[1] <= 12 THEN mf END"

ORACLE: dict[str, str] = {
    "drug_strings": f"""WITH l AS ({plain(LINES)}), t AS (SELECT *, string_split(trim(regexp_replace(upper(regexp_replace(replace(raw, '×', ' x '), '[-_.,/''"()\\[\\]]', ' ', 'g')), '\\s+', ' ', 'g')), ' ') AS w FROM l)
      SELECT item, array_to_string(list_filter(w, lambda x: NOT list_contains({_list((*text.FORM_WORDS, *text.DOSING_WORDS, "X"))}, x) AND NOT regexp_full_match(x, '\\d+(\\.\\d+)?(MG|MGS|G|GM|GMS|MCG|UG|ML|L|IU|%)?') AND NOT regexp_full_match(x, 'X?\\d+(/\\d+)?[A-Z]*')), ' ') AS cleaned,
        coalesce(nullif(trim(name), ''), nullif(trim(raw), '')) AS label FROM t""",
    "line_classes": f"""WITH l AS (SELECT *, nullif(lower(trim(form)), '') AS f, lower(coalesce(printed, '') || ' ' || coalesce(raw, '')) AS said FROM ({plain(LINES)}) x), n AS (SELECT *, {_FORM} AS kind, len(list_filter({_list(forms.NON_MEDICINE_WORDS)}, lambda w: contains(said, w))) > 0 AS worded FROM l)
      SELECT item, kind AS form, CASE WHEN resolved THEN 'medicine' WHEN worded OR coalesce(kind IN ('other', 'service', 'consumable'), false) THEN 'non_medicine' WHEN kind IS NOT NULL THEN 'medicine' ELSE 'unclassified' END AS class,
        coalesce(kind IN ('other', 'service', 'consumable'), false) OR (NOT resolved AND kind IS NULL) AS outside FROM n""",
    "strength_parts": f"""WITH l AS (SELECT item, list_filter(regexp_split_to_array(strength, '[+/]'), lambda p: regexp_matches(p, '[0-9]')) AS parts FROM ({plain(LINES)}) x), e AS (SELECT item, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS k FROM l),
      r AS (SELECT item, k, CAST(regexp_extract(p, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS v, nullif(lower(regexp_extract(p, '\\d\\s*([a-zA-Z]+)', 1)), '') AS u FROM e), w AS (SELECT *, coalesce(u, last_value(u IGNORE NULLS) OVER (PARTITION BY item ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS unit FROM r)
      SELECT item, CAST(k AS INT) AS k, round(v * CASE WHEN unit IN ('g', 'gm') THEN 1000 ELSE 1 END, 4) AS value, CASE WHEN unit IN ('g', 'gm') THEN 'mg' ELSE unit END AS unit FROM w""",
    "person_names": f"""WITH p AS (SELECT *, trim(coalesce(written, '')) AS full_, regexp_split_to_array(trim(coalesce(written, '')), '\\s+') AS w FROM ({plain(PEOPLE)}) x),
      t AS (SELECT *, list_filter(regexp_split_to_array(replace(lower(written), '.', ' '), '\\s+'), lambda z: NOT list_contains({_list((*text.TITLES, ""))}, z)) AS a, list_filter(regexp_split_to_array(replace(lower(other), '.', ' '), '\\s+'), lambda z: NOT list_contains({_list((*text.TITLES, ""))}, z)) AS b,
        list_filter({_list(sorted(set(text.STATES.values())))}, lambda s: contains(upper(address), upper(s))) AS states FROM p)
      SELECT person, CASE WHEN written IS NULL OR other IS NULL THEN NULL ELSE len(a) = 0 OR len(b) = 0 OR list_has_any(a, b) END AS same, CASE WHEN len(w) <= 3 THEN w[1] ELSE full_ END AS first, CASE WHEN len(w) = 3 THEN w[2] ELSE '' END AS middle, CASE WHEN len(w) IN (2, 3) THEN w[-1] ELSE '' END AS last,
        CASE WHEN regexp_full_match(upper(trim(money)), '[A-Z]{{3}}') THEN upper(trim(money)) ELSE 'INR' END AS currency, CASE WHEN len(states) = 1 THEN states[1] END AS state, length(trim(coalesce(licence, ''))) > 0 AS licensed FROM t""",
    "gstin_problems": f"""WITH n AS (SELECT seller, nullif(upper(regexp_replace(printed, '[\\s-]', '', 'g')), '') AS number FROM ({plain(NUMBERS)}) x),
      s AS (SELECT *, {_cases(text.STATES.items(), "substr(number, 1, 2)")} AS state, list_sum(list_transform(range(1, 15), lambda i: (instr({_DIGITS}, substr(number, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 36 + (instr({_DIGITS}, substr(number, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 36)) AS total FROM n),
      q AS (SELECT *, CASE WHEN number IS NULL THEN NULL WHEN length(number) <> 15 THEN 'length' WHEN NOT regexp_full_match(number, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]') THEN 'pattern' WHEN state IS NULL THEN 'state' WHEN substr(number, 15, 1) <> substr({_DIGITS}, CAST((36 - total % 36) % 36 + 1 AS BIGINT), 1) THEN 'check_digit' END AS problem FROM s)
      SELECT seller, number, problem, CASE WHEN number IS NOT NULL THEN problem IS NULL END AS valid, state FROM q""",
    "date_resolve": f"""WITH {_DATES} SELECT item, {_VALUE.format(either="df")} AS dmy, {_VALUE.format(either="mf")} AS mdy, {_VALUE.format(either="NULL")} AS strict,
      {_TOLD.format(either="CASE WHEN df IS NULL THEN 'invalid' ELSE 'assumed' END")} AS dmy_status, {_TOLD.format(either="'ambiguous'")} AS strict_status FROM v""",
    "expiry_resolve": f"""WITH e AS (SELECT item, trim(expiry) AS x, list_filter(regexp_split_to_array(trim(expiry), '[^0-9A-Za-z]+'), lambda p: p <> '') AS p FROM ({plain(DATES)}) z),
      f AS (SELECT *, regexp_full_match(p[1], '\\d+') AS a, regexp_full_match(p[2], '\\d+') AS b FROM e WHERE len(p) = 2),
      g AS (SELECT *, CASE WHEN a AND b AND length(p[1]) = 4 THEN CAST(p[2] AS INT) WHEN a AND b THEN CAST(p[1] AS INT) WHEN b AND ({_WORD.format(w="p[1]")} OR lower(p[1]) = 'sept') THEN {_MONTH.format(w="p[1]")} WHEN a AND ({_WORD.format(w="p[2]")} OR lower(p[2]) = 'sept') THEN {_MONTH.format(w="p[2]")} END AS m,
        CAST(CASE WHEN a AND b AND length(p[1]) = 4 THEN p[1] WHEN b THEN p[2] WHEN a THEN p[1] END AS INT) AS y FROM f),
      h AS (SELECT item, CASE WHEN m BETWEEN 1 AND 12 THEN last_day({_DAY.format(y="(" + _YEAR.format(y="y") + ")", m="m", d="1")}) END AS expiry, CASE WHEN NOT coalesce(m BETWEEN 1 AND 12, false) THEN 'unreadable' WHEN {_YEAR.format(y="y")} IS NULL THEN 'year' ELSE 'read' END AS status FROM g),
      three AS (SELECT item, CAST(p[1] AS INT) AS d, CAST(p[2] AS INT) AS m, CAST(p[3] AS INT) AS y FROM e WHERE len(p) = 3)
      SELECT * FROM h UNION ALL SELECT item, {_DAY.format(y="y", m="m", d="d")}, CASE WHEN d <= 12 THEN 'assumed' ELSE 'read' END FROM three UNION ALL SELECT item, NULL, CASE WHEN x <> '-' THEN 'unreadable' END FROM e WHERE len(p) NOT IN (2, 3)""",
    "price_basis": f"""WITH p AS (SELECT *, quantity * price AS stated, quantity * price * per_pack AS packed FROM ({plain(PRICES)}) x), q AS (SELECT *, abs(stated - total) <= 0.02 * greatest(abs(stated), abs(total), 1.0) AS s, abs(packed - total) <= 0.02 * greatest(abs(packed), abs(total), 1.0) AS k, per_pack IS NOT NULL AS known FROM p),
      r AS (SELECT CASE WHEN declared IS NOT NULL THEN declared WHEN known AND k AND NOT s THEN 'pack' END AS basis, CASE WHEN declared IS NOT NULL THEN 'declared' WHEN NOT known THEN 'no_price_data' WHEN k AND NOT s THEN 'price_reconciled' ELSE 'price_inconclusive' END AS method, least(1.0, greatest(0.0, share)) AS share,
        x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x1 > x0 AND y1 > y0 AS box_ok, least(100.0, quantity * 900 * 100 / total) AS used, price * 100 / total AS want FROM q)
      SELECT basis, method, box_ok, count(*) AS n, round(sum(share), 2)::DOUBLE AS share, round(sum(used), 2)::DOUBLE AS used, round(sum(greatest(0.0, least(want, 100 - used))), 2)::DOUBLE AS claim FROM r GROUP BY ALL""",
}
