"""Predicates, scalar rules, joins, set operations and reshaping on the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from breathline.catalog.binding import (
    day_number,
    events_long,
    read,
    rounded,
    sql_events,
    sql_half_even,
)
from breathline.functions import clinical, numeric, text
from breathline.operators import joins, ordering, reshape, sampling, summaries
from breathline.sources.tables import rows_of_key, rows_of_keys

CUST = "o_custkey"


def _customers(spark, d):
    return read(spark, d, "customer").withColumnRenamed("c_custkey", CUST)


def _order_ids(spark, d, condition):
    return read(spark, d, "orders").filter(condition).select(CUST)


def semi_in_union(spark, d):
    sets = [
        _order_ids(spark, d, "o_orderstatus = 'F' AND o_totalprice > 450000"),
        _order_ids(spark, d, "o_orderpriority = '1-URGENT' AND o_totalprice > 400000"),
    ]
    return joins.with_ids(_customers(spark, d), sets, CUST).select(CUST, "c_mktsegment")


def anti_not_in(spark, d):
    sets = [
        _order_ids(spark, d, "o_orderstatus = 'P' AND o_totalprice > 300000"),
        _order_ids(spark, d, "o_orderpriority = '5-LOW' AND o_totalprice > 450000"),
    ]
    return joins.without_ids(_customers(spark, d), sets, CUST).select(CUST, "c_mktsegment")


def semi_and_anti(spark, d):
    """Rows with one condition in either source and without the other in both."""
    good = [_order_ids(spark, d, "o_orderstatus = 'F'"), _order_ids(spark, d, "o_orderpriority = '2-HIGH'")]
    bad = [_order_ids(spark, d, "o_totalprice > 480000"), _order_ids(spark, d, "o_totalprice < 2000")]
    return joins.without_ids(joins.with_ids(_customers(spark, d), good, CUST), bad, CUST).select(CUST)


def common_ids(spark, d):
    sets = [_order_ids(spark, d, f"o_orderstatus = '{s}'") for s in "FOP"]
    return joins.common_ids(sets, CUST)


def id_set_difference(spark, d):
    wanted = [_order_ids(spark, d, "o_totalprice > 400000"), _order_ids(spark, d, "o_orderstatus = 'P'")]
    return joins.subtract_ids(wanted, _order_ids(spark, d, "o_orderpriority = '1-URGENT'"), CUST)


def interval_containment(spark, d):
    """Line items shipped within the 90 days from their order's date."""
    orders = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        day_number(F.col("o_orderdate")).alias("from_day"),
        (day_number(F.col("o_orderdate")) + 90).alias("to_day"),
    )
    items = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        day_number(F.col("l_shipdate")).alias("begin_day"),
        (day_number(F.col("l_shipdate")) + F.col("l_linenumber")).alias("end_day"),
    )
    inside = joins.contained_join(items, orders, "l_orderkey", "begin_day", "end_day", "from_day", "to_day")
    return inside.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("begin_day").alias("first_day"), F.max("end_day").alias("last_day")
    )


def interval_containment_any_order(spark, d):
    """Containment of events that may end before they begin: line items with a stop day long before the shipping day."""
    orders = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        day_number(F.col("o_orderdate")).alias("from_day"),
        (day_number(F.col("o_orderdate")) + 30).alias("to_day"),
    )
    items = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", day_number(F.col("l_shipdate")).alias("begin_day"),
        (day_number(F.col("l_shipdate")) - 20 * F.col("l_linenumber")).alias("end_day"),
    )
    inside = joins.contained_join(items, orders, "l_orderkey", "begin_day", "end_day", "from_day", "to_day")
    return inside.select("l_orderkey", "l_linenumber", "begin_day", "end_day")


def star_left_join(spark, d):
    orders = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"
    )
    lines = read(spark, d, "lineitem")
    spend = lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")
    late = lines.filter("l_linestatus = 'O'").select("l_orderkey", "l_quantity")
    star = joins.star_join(
        orders, "l_orderkey",
        [
            (spend, [F.count(F.lit(1)).alias("returned"), F.max("l_extendedprice").alias("top_price")]),
            (late, [F.sum("l_quantity").alias("open_quantity")]),
        ],
    )
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return star.join(customer, "o_custkey", "left")


def or_join(spark, d):
    """Orders and customers of one key meeting either of two cross-table conditions."""
    either = [
        (F.col("o_totalprice") > 400000) & (F.col("c_acctbal") < 0),
        (F.col("o_orderstatus") == "P") & (F.col("c_mktsegment") == "BUILDING"),
    ]
    joined = joins.conditions_join(read(spark, d, "orders"), _customers(spark, d), CUST, either)
    return joined.select("o_orderkey", CUST, "o_orderstatus", "c_mktsegment")


def refresh_by_key(spark, d):
    updates = (
        read(spark, d, "orders").groupBy(F.col(CUST).alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("c_acctbal"), F.min("o_orderstatus").alias("c_mktsegment"))
        .filter("c_acctbal > 480000")
    )
    out = joins.refresh_columns(read(spark, d, "customer"), updates, "c_custkey", ["c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def score_lookup(spark, d):
    ids = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col(CUST).alias("c_custkey"))
    scores = read(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, -1).otherwise(F.floor("c_acctbal").cast("int")).alias("score")
    )
    return joins.lookup_score(ids, scores, "c_custkey", "score")


def key_lookup(spark, d):
    hot = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 80")
    many = rows_of_keys(read(spark, d, "events"), hot, "user_id").select("event_id", "user_id", "event_type")
    one = rows_of_key(read(spark, d, "events"), "user_id", 1).select("event_id", "user_id", "event_type")
    return many.withColumn("kind", F.lit("many")).unionByName(one.withColumn("kind", F.lit("one")))


def clipped_range(spark, d):
    rows = joins.clipped(events_long(spark, d), "offset_min", 1440, 20160)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("offset_min").alias("last_minute"))


def text_predicates(spark, d):
    t = F.col("text")
    flags = {
        "like_any": text.like_any(t, ["%the%", "The%", "%."]),
        "like_but_not": text.like_but_not(t, ["%e%"], ["%the%"]),
        "contains": text.contains_ci(t, "License"),
        "any_word": text.contains_any_ci(t, ["password", "EMAIL", "copyright"]),
        "digit": text.has_digit(t),
        "letter": text.has_letter(t),
        "no_contains": ~text.contains_ci(t, "the"),
        "known_lang": F.col("lang").isin("en", "de"),
    }
    return read(spark, d, "documents").select(
        "doc_id", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()]
    )


def text_to_number(spark, d):
    number = text.to_number(F.regexp_extract("props", r":\s*([^}]*)", 1))
    raw = text.to_number(F.col("props"))
    rows = read(spark, d, "events").select(number.alias("k"), raw.alias("raw"), F.col("event_type"))
    return rows.groupBy("event_type").agg(
        F.count("k").alias("n_numbers"), F.count("raw").alias("n_raw"), F.sum("k").alias("total"),
        F.count(F.when(F.col("k") > 21, 1)).alias("above"),
    )


def text_compared_as_number(spark, d):
    brand = F.regexp_extract("p_brand", "#(.*)$", 1)
    return read(spark, d, "part").select(
        "p_partkey", F.coalesce(text.number_above(brand, 9), F.lit(False)).cast("int").alias("above_nine")
    )


AGE_TEXT = (
    "CASE WHEN c_acctbal > 9000 THEN '> 89' WHEN c_acctbal < -900 THEN '' WHEN c_acctbal < 0 THEN 'unknown' "
    "ELSE CAST(CAST(floor(c_acctbal / 100) AS INT) AS {string}) END"
)


def age_norm(spark, d):
    rows = read(spark, d, "customer").withColumn("age", F.expr(AGE_TEXT.format(string="STRING")))
    return rows.select(
        "c_custkey",
        clinical.age_years(F.col("age")).alias("age"),
        clinical.age_years(F.col("age"), unknown=None).alias("age_or_null"),
        clinical.is_adult(F.col("age")).cast("int").alias("adult"),
    )


def encode_case(spark, d):
    source = F.expr(
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Emergency Department' WHEN 'BUILDING' THEN 'Operating Room' "
        "WHEN 'AUTOMOBILE' THEN 'Floor' WHEN 'HOUSEHOLD' THEN 'Direct Admit' ELSE 'Other place' END"
    )
    return read(spark, d, "customer").select(
        "c_custkey",
        clinical.admit_source_code(source).alias("source_code"),
        clinical.gender_code(F.when(F.col("c_nationkey") < 10, F.lit("Female")).otherwise(F.lit("Male"))).alias("gender"),
        numeric.positive_or_null(F.col("c_acctbal")).alias("positive_balance"),
    )


def bmi(spark, d):
    height = F.expr("CASE WHEN p_size < 10 THEN 1.5 + p_size / 10.0D WHEN p_size < 25 THEN 2.5 + p_size ELSE 140 + p_size END")
    return read(spark, d, "part").select(
        "p_partkey", clinical.body_mass_index(F.col("p_retailprice") / 20, height.cast("double")).alias("bmi")
    )


def los_days(spark, d):
    minutes = (F.col("l_quantity") * 997 - 20000).cast("bigint")
    return read(spark, d, "lineitem").groupBy(
        clinical.stay_days(minutes).alias("days"),
        clinical.stay_days(minutes, F.col("l_linenumber") * F.lit(2000)).alias("hospital_days"),
    ).agg(F.count(F.lit(1)).alias("n"))


def fio2_ratio(spark, d):
    fio2 = F.col("l_quantity") * F.col("l_discount")
    rows = read(spark, d, "lineitem").select(
        "l_returnflag",
        numeric.safe_ratio(F.col("l_quantity"), clinical.fio2_fraction(fio2)).alias("pf"),
        clinical.fio2_fraction(fio2, F.lit(60.0)).alias("f"),
    )
    return rows.groupBy("l_returnflag").agg(
        F.count("pf").alias("n_pf"), F.round(F.avg("pf"), 4).alias("mean_pf"),
        F.round(F.avg("f"), 6).alias("mean_f"), F.count(F.lit(1)).alias("n"),
    )


def severity_counts(spark, d):
    band = clinical.severity_band(F.col("l_quantity") * 10 - 50)
    return summaries.class_counts(read(spark, d, "lineitem").select(band.alias("severity")), "severity")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'P' THEN NULL ELSE 'Alive' END"
HOSPITAL_STATUS = "CASE WHEN o_orderpriority < '3' THEN 'Expired' ELSE 'Alive' END"
UNIT_PLACE = "CASE WHEN o_orderkey % 3 = 0 THEN 'Home' WHEN o_orderkey % 3 = 1 THEN 'Floor' END"
HOSPITAL_PLACE = "CASE WHEN o_custkey % 3 = 0 THEN 'Home' WHEN o_custkey % 3 = 1 THEN 'Other' END"
MINUTES = "CAST(floor(o_totalprice / 8) AS BIGINT)"


def _stays(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey", "o_custkey",
        F.expr(STATUS).alias("us"), F.expr(HOSPITAL_STATUS).alias("hs"),
        F.expr(UNIT_PLACE).alias("ul"), F.expr(HOSPITAL_PLACE).alias("hl"), F.expr(MINUTES).alias("um"),
    )


def detail_code(spark, d):
    unit = clinical.stay_days(F.col("um"))
    hospital = clinical.stay_days(F.col("um") + 4000)
    code = clinical.death_detail(F.col("us"), F.col("hs"), F.col("ul"), F.col("hl"), unit, hospital)
    return _stays(spark, d).select("o_orderkey", code.alias("detail"), unit.alias("unit"), hospital.alias("hospital"))


def outcome_code(spark, d):
    hypoxic = F.col("o_custkey") % 7 == 0
    code = clinical.outcome_class(
        hypoxic, F.col("us"), F.col("hs"), F.col("um"), F.col("um") + 4000, F.col("o_custkey") * 20
    )
    return _stays(spark, d).select("o_orderkey", code.alias("status"))


def discharge_category(spark, d):
    days = clinical.stay_days(F.col("um") - 3000)
    return _stays(spark, d).groupBy(clinical.discharge_category(F.col("us"), days).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


def rounding_rules(spark, d):
    rows = read(spark, d, "lineitem").select(
        "l_linenumber",
        numeric.half_even(F.col("l_extendedprice") / 8, 2).alias("even2"),
        numeric.half_even(F.col("l_extendedprice") / 8, 1).alias("even1"),
    )
    return rows.groupBy("l_linenumber").agg(
        F.round(F.sum("even2"), 2).alias("sum2"), F.round(F.sum("even1"), 1).alias("sum1")
    )


def binarise(spark, d):
    status = F.col("l_linenumber") - 1
    rows = read(spark, d, "lineitem").select(
        status.alias("status"), numeric.binary_label(status).alias("label"),
        numeric.collapse_classes(status).alias("collapsed"),
        numeric.enrollment_from_onset(status).alias("enrollment"),
    )
    return rows.groupBy("status", "label", "collapsed", "enrollment").agg(F.count(F.lit(1)).alias("n"))


def label_counts_having(spark, d):
    keys = ["user_id", "event_type"]
    return summaries.counts_having(read(spark, d, "events"), keys, (F.col("n") >= 12) & F.col("event_type").contains("i"))


def table_profile(spark, d):
    return summaries.table_profile(read(spark, d, "events"), "user_id")


def label_profile(spark, d):
    return summaries.label_profile(read(spark, d, "part"), "p_name")


def class_counts(spark, d):
    return summaries.class_counts(read(spark, d, "documents"), "lang")


def flag_pivot(spark, d):
    return _name_flags(spark, d)


NAME_RULES = {"red": ["red %"], "rings": ["% ring", "%rings%"], "large": ["large%"], "widget": ["%widget%"]}
NAME_EXCEPT = {"widget": ["%small%"]}
TYPE_RULES = {"large": ["LARGE%"], "promo": ["%PROMO%"], "red": ["STANDARD"]}
FLAGS = ["red", "rings", "large", "widget", "promo", "unknown"]


def _parts_of_orders(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")


def _name_flags(spark, d):
    return reshape.flag_pivot(_parts_of_orders(spark, d), "l_orderkey", "p_name", NAME_RULES, NAME_EXCEPT)


def flag_merge(spark, d):
    second = reshape.flag_pivot(_parts_of_orders(spark, d), "l_orderkey", "p_type", TYPE_RULES)
    return reshape.merge_flags([_name_flags(spark, d), second], "l_orderkey", FLAGS)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def unpivot_measures(spark, d):
    long = reshape.unpivot_positive(read(spark, d, "lineitem"), ["l_orderkey"], MEASURES)
    return long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("top")
    )


def union_sources(spark, d):
    """Six sources of one long table, counted per name."""
    ev = events_long(spark, d).select(F.col("stay_id").alias("k"), "name", "value")
    props = read(spark, d, "events").select(
        F.col("user_id").alias("k"), F.lit("props").alias("name"),
        text.to_number(F.regexp_extract("props", r":\s*([^}]*)", 1)).alias("value"),
    )
    orders = read(spark, d, "orders").select(
        F.col(CUST).alias("k"), F.lit("price").alias("name"), F.col("o_totalprice").alias("value")
    )
    lines = reshape.unpivot_positive(
        read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), *MEASURES), ["k"], MEASURES
    )
    customer = read(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.lit("balance").alias("name"),
        numeric.positive_or_null(F.col("c_acctbal")).alias("value"),
    )
    part = read(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.lit("brand").alias("name"),
        text.to_number(F.regexp_extract("p_brand", "#(.*)$", 1)).alias("value"),
    )
    rows = reshape.union_sources([ev, props, orders, lines, customer, part], ["k", "name", "value"])
    return rows.filter("value IS NOT NULL").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def union_distinct(spark, d):
    a = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"))
    b = read(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), (F.col(CUST) % 10).cast("int").alias("n"))
    return reshape.union_distinct([a, b], ["s", "n"])


def equipment_ids(spark, d):
    return reshape.union_distinct(
        [
            read(spark, d, "events").filter("event_type = 'signup' AND value >= 150").select(F.col("user_id").alias("id")),
            read(spark, d, "orders").filter("o_totalprice >= 450000").select(F.col(CUST).alias("id")),
            read(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_custkey").alias("id")),
        ],
        ["id"],
    )


def top_rows(spark, d):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return ordering.top_rows(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), order, 25)


def row_slice(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", CUST)
    return ordering.slice_rows(rows, "o_orderkey", 700, 1400)


def positions(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return ordering.with_position(rows, "c_custkey", keys=["nation"])


def label_encode(spark, d):
    coded = sampling.encode_labels(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return coded.select("c_custkey", "c_mktsegment", "label_code")


QUERIES = {
    f.__name__: f
    for f in (
        semi_in_union, anti_not_in, semi_and_anti, common_ids, id_set_difference, interval_containment, interval_containment_any_order,
        star_left_join, or_join, refresh_by_key, score_lookup, key_lookup, clipped_range,
        text_predicates, text_to_number, text_compared_as_number, age_norm, encode_case, bmi, los_days,
        fio2_ratio, severity_counts, detail_code, outcome_code, discharge_category, rounding_rules,
        binarise, label_counts_having, table_profile, label_profile, class_counts, flag_pivot,
        flag_merge, unpivot_measures, union_sources, union_distinct, equipment_ids, top_rows,
        row_slice, positions, label_encode,
    )
}


def _sql_flag(column: str, name: str, rules: dict, unwanted: dict) -> str:
    hit = " OR ".join(f"{column} LIKE '{p}'" for p in rules[name])
    not_these = "".join(f" AND {column} NOT LIKE '{p}'" for p in unwanted.get(name, []))
    return f"CAST(max(CASE WHEN ({hit}){not_these} THEN 1 ELSE 0 END) AS INTEGER) AS {name}"


_PARTS = "lineitem JOIN part ON l_partkey = p_partkey"
_NAME_FLAGS = ", ".join(_sql_flag("p_name", n, NAME_RULES, NAME_EXCEPT) for n in NAME_RULES)
_TYPE_FLAGS = ", ".join(_sql_flag("p_type", n, TYPE_RULES, {}) for n in TYPE_RULES)
_STAYS = f"""WITH s AS (SELECT o_orderkey, o_custkey, {STATUS} AS us, {HOSPITAL_STATUS} AS hs,
  {UNIT_PLACE} AS ul, {HOSPITAL_PLACE} AS hl, {MINUTES} AS um FROM orders)"""
_DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
_AGE = AGE_TEXT.format(string="VARCHAR")

SQL = {
    "semi_in_union": """SELECT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000
  UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""",
    "anti_not_in": """SELECT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000
  UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 450000)""",
    "semi_and_anti": """SELECT c_custkey AS o_custkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '2-HIGH')
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000 OR o_totalprice < 2000)""",
    "common_ids": """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT
SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT
SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "id_set_difference": """(SELECT o_custkey FROM orders WHERE o_totalprice > 400000
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "interval_containment_any_order": """SELECT l_orderkey, l_linenumber, begin_day, end_day FROM (
  SELECT l_orderkey, l_linenumber, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS begin_day,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) - 20 * l_linenumber AS INTEGER) AS end_day FROM lineitem)
JOIN (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS from_day FROM orders) ON l_orderkey = o_orderkey
WHERE begin_day >= from_day AND end_day < from_day + 30""",
    "interval_containment": f"""WITH j AS (SELECT l_orderkey, {_DAY.format('l_shipdate')} AS b,
  {_DAY.format('l_shipdate')} + l_linenumber AS e, {_DAY.format('o_orderdate')} AS f
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, count(*) AS n, CAST(min(b) AS INTEGER) AS first_day, CAST(max(e) AS INTEGER) AS last_day
FROM j WHERE b >= f AND e < f + 90 GROUP BY 1""",
    "star_left_join": """SELECT o_orderkey AS l_orderkey, o_custkey, o_totalprice, returned, top_price, open_quantity, c_mktsegment
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS returned, max(l_extendedprice) AS top_price FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS open_quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b
  ON b.l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
    "or_join": """SELECT o_orderkey, o_custkey, o_orderstatus, c_mktsegment FROM orders, customer
WHERE o_custkey = c_custkey AND ((o_totalprice > 400000 AND c_acctbal < 0)
  OR (o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'))""",
    "refresh_by_key": """SELECT c_custkey, c_name, coalesce(p, c_acctbal) AS c_acctbal, coalesce(s, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p, min(o_orderstatus) AS s FROM orders GROUP BY 1
  HAVING max(o_totalprice) > 480000) ON o_custkey = c_custkey""",
    "score_lookup": """SELECT c_custkey, score FROM (SELECT c_custkey,
  CASE WHEN c_acctbal < 0 THEN -1 ELSE CAST(floor(c_acctbal) AS INTEGER) END AS score FROM customer)
WHERE score <> -1 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "key_lookup": """SELECT event_id, user_id, event_type, 'many' AS kind FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 80)
UNION ALL SELECT event_id, user_id, event_type, 'one' FROM events WHERE user_id = 1""",
    "clipped_range": f"""WITH {sql_events()}
SELECT name, count(*) AS n, max(offset_min) AS last_minute FROM m WHERE offset_min >= 1440 AND offset_min < 20160 GROUP BY 1""",
    "text_predicates": """SELECT doc_id,
  CAST(text LIKE '%the%' OR text LIKE 'The%' OR text LIKE '%.' AS INTEGER) AS like_any,
  CAST(text LIKE '%e%' AND text NOT LIKE '%the%' AS INTEGER) AS like_but_not,
  CAST(contains(lower(text), 'license') AS INTEGER) AS contains,
  CAST(contains(lower(text), 'password') OR contains(lower(text), 'email')
    OR contains(lower(text), 'copyright') AS INTEGER) AS any_word,
  CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS digit,
  CAST(regexp_matches(text, '[a-zA-Z]') AS INTEGER) AS letter,
  CAST(NOT contains(lower(text), 'the') AS INTEGER) AS no_contains,
  CAST(lang IN ('en', 'de') AS INTEGER) AS known_lang FROM documents""",
    "text_to_number": """SELECT event_type, count(k) AS n_numbers, count(raw) AS n_raw, sum(k) AS total,
  count(*) FILTER (k > 21) AS above FROM (SELECT event_type, try_cast(props AS DOUBLE) AS raw,
  try_cast(regexp_extract(props, ':\\s*([^}]*)', 1) AS DOUBLE) AS k FROM events) GROUP BY 1""",
    "text_compared_as_number": """SELECT p_partkey, CAST(try_cast(regexp_extract(p_brand, '#(.*)$', 1) AS DOUBLE) > 9 AS INTEGER)
  AS above_nine FROM part""",
    "age_norm": f"""WITH t AS (SELECT c_custkey, {_AGE} AS age FROM customer),
a AS (SELECT c_custkey, CASE WHEN age = '> 89' THEN 90.0 WHEN regexp_matches(age, '[0-9]')
  THEN try_cast(age AS DOUBLE) END AS v FROM t)
SELECT c_custkey, CAST(coalesce(v, 91) AS DOUBLE) AS age, CAST(v AS DOUBLE) AS age_or_null,
  CAST(coalesce(v >= 18, false) AS INTEGER) AS adult FROM a""",
    "encode_case": """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1
  WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS source_code,
  CASE WHEN c_nationkey < 10 THEN 0 ELSE 1 END AS gender,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive_balance FROM customer""",
    "bmi": f"""WITH p AS (SELECT p_partkey, p_retailprice / 20 AS w, CAST(CASE WHEN p_size < 10 THEN 1.5 + p_size / 10
  WHEN p_size < 25 THEN 2.5 + p_size ELSE 140 + p_size END AS DOUBLE) AS h FROM part),
m AS (SELECT *, CASE WHEN h > 1 AND h < 2.5 THEN h WHEN h >= 100 THEN h / 100 END AS m FROM p)
SELECT p_partkey, CASE WHEN w >= 10 THEN {sql_half_even('w / (m * m)', 2)} END AS bmi FROM m""",
    "los_days": """WITH m AS (SELECT CAST(l_quantity * 997 - 20000 AS BIGINT) AS x, l_linenumber * 2000 AS a FROM lineitem)
SELECT CAST(trunc(x / 1440) AS BIGINT) AS days, CAST(trunc((x - a) / 1440) AS BIGINT) AS hospital_days,
  count(*) AS n FROM m GROUP BY 1, 2""",
    "fio2_ratio": """WITH m AS (SELECT l_returnflag, l_quantity AS p, l_quantity * l_discount AS f FROM lineitem)
SELECT l_returnflag, count(*) FILTER (f <> 0) AS n_pf,
  round(avg(p / CASE WHEN f > 1 THEN f / 100 WHEN f = 0 THEN NULL ELSE f END), 4) AS mean_pf,
  round(avg(CASE WHEN f < 1e-6 THEN 0.6 WHEN f > 1 THEN f / 100 ELSE f END), 6) AS mean_f,
  count(*) AS n FROM m GROUP BY 1""",
    "severity_counts": """SELECT CASE WHEN q <= 100 THEN 1 WHEN q <= 200 THEN 2 WHEN q <= 300 THEN 3 ELSE 4 END AS severity,
  count(*) AS n FROM (SELECT l_quantity * 10 - 50 AS q FROM lineitem) GROUP BY 1""",
    "detail_code": f"""{_STAYS},
x AS (SELECT *, um // 1440 AS unit, (um + 4000) // 1440 AS hospital FROM s)
SELECT o_orderkey, CAST(CASE
  WHEN us = 'Expired' AND hl IS DISTINCT FROM 'Home' THEN 0
  WHEN us = 'Expired' THEN CASE WHEN unit < 28 THEN 1 ELSE 3 END
  WHEN hs = 'Expired' THEN CASE WHEN hospital < 28 THEN 1 WHEN ul IS DISTINCT FROM 'Home' THEN 2 ELSE 3 END
  ELSE -1 END AS INTEGER) AS detail, unit, hospital FROM x""",
    "outcome_code": f"""{_STAYS},
x AS (SELECT *, o_custkey * 20 + 1440 AS lim, um + 4000 AS hm FROM s)
SELECT o_orderkey, CAST(CASE WHEN o_custkey % 7 = 0 THEN 1
  WHEN us = 'Expired' AND um <= lim THEN 2 WHEN hs = 'Expired' AND hm <= lim THEN 2
  WHEN us IS DISTINCT FROM 'Expired' AND um <= lim THEN 0
  WHEN hs IS DISTINCT FROM 'Expired' AND hm <= lim THEN 0 ELSE 1 END AS INTEGER) AS status FROM x""",
    "discharge_category": f"""{_STAYS},
x AS (SELECT us, CAST(trunc((um - 3000) / 1440) AS BIGINT) AS d FROM s)
SELECT CASE WHEN us LIKE '%Alive%' AND d > 1 THEN 'long stay' WHEN us LIKE '%Alive%' AND d < 1 THEN 'spontaneous recovery'
  WHEN us LIKE '%Expired%' AND d < 1 THEN 'icu-day Mortality' ELSE 'hospital Mortality' END AS category,
  count(*) AS n FROM x GROUP BY 1""",
    "rounding_rules": f"""SELECT l_linenumber, round(sum({sql_half_even('l_extendedprice / 8', 2)}), 2) AS sum2,
  round(sum({sql_half_even('l_extendedprice / 8', 1)}), 1) AS sum1 FROM lineitem GROUP BY 1""",
    "binarise": """SELECT l_linenumber - 1 AS status, CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS label,
  least(l_linenumber - 1, 2) AS collapsed, l_linenumber + 1439 AS enrollment, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "label_counts_having": """SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING count(*) >= 12 AND position('i' IN event_type) > 0""",
    "table_profile": "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events",
    "label_profile": "SELECT DISTINCT p_name FROM part ORDER BY 1",
    "class_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "flag_pivot": f"SELECT l_orderkey, {_NAME_FLAGS} FROM {_PARTS} GROUP BY 1",
    "flag_merge": f"""WITH a AS (SELECT l_orderkey, {_NAME_FLAGS} FROM {_PARTS} GROUP BY 1),
b AS (SELECT l_orderkey, {_TYPE_FLAGS} FROM {_PARTS} GROUP BY 1)
SELECT l_orderkey, greatest(a.red, b.red) AS red, rings, greatest(a.large, b.large) AS large, widget, promo,
  0 AS unknown FROM a JOIN b USING (l_orderkey)""",
    "unpivot_measures": f"""SELECT name, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM (
  UNPIVOT (SELECT {', '.join(MEASURES)} FROM lineitem) ON {', '.join(MEASURES)} INTO NAME name VALUE value)
WHERE value > 0 GROUP BY 1""",
    "union_sources": f"""WITH {sql_events()},
u AS (SELECT name, value FROM m
  UNION ALL SELECT 'props', try_cast(regexp_extract(props, ':\\s*([^}}]*)', 1) AS DOUBLE) FROM events
  UNION ALL SELECT 'price', o_totalprice FROM orders
  UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem WHERE l_quantity > 0
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem WHERE l_extendedprice > 0
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem WHERE l_discount > 0
  UNION ALL SELECT 'l_tax', l_tax FROM lineitem WHERE l_tax > 0
  UNION ALL SELECT 'balance', c_acctbal FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 'brand', try_cast(regexp_extract(p_brand, '#(.*)$', 1) AS DOUBLE) FROM part)
SELECT name, count(*) AS n, min(value) AS low, max(value) AS high FROM u WHERE value IS NOT NULL GROUP BY 1""",
    "union_distinct": """SELECT l_linestatus AS s, l_linenumber AS n FROM lineitem
UNION SELECT o_orderstatus, CAST(o_custkey % 10 AS INTEGER) FROM orders""",
    "equipment_ids": """SELECT user_id AS id FROM events WHERE event_type = 'signup' AND value >= 150
UNION SELECT o_custkey FROM orders WHERE o_totalprice >= 450000
UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9500""",
    "top_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "row_slice": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 700",
    "positions": """SELECT c_custkey, c_nationkey AS nation,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer""",
    "label_encode": """SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER)
  AS label_code FROM customer""",
}
