"""Queries for column selection, audits, outcome rules, derived measures and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as K
from ..functions import outcomes as O
from .aggregates import rounded
from .registry import query, read

ROLES = K.Roles(id="o_orderkey", target="o_orderstatus", time="o_orderdate", group="o_orderpriority", features=("o_custkey",))
NUMBER = "max(isfinite(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) IS TRUE)"
USABLE = "SELECT " + ", ".join(NUMBER.format(c=c) + f" AS {c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + " FROM orders"
#: (column, usable) for each column of orders, from the table's values.
LONG = f"(UNPIVOT ({USABLE}) ON COLUMNS(*) INTO NAME c VALUE usable)"


@query(f"""SELECT c AS "column" FROM {LONG} WHERE usable AND c NOT IN ('o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority') AND NOT regexp_matches(c, 'key$')""")
def column_selection(spark, d):
    chosen = K.select_columns(read(spark, d, "orders"), exclude=["key$"], roles=ROLES)
    return spark.createDataFrame([(c,) for c in chosen], "column string")


GROUPS = {"money": ["o_totalprice", "o_orderstatus"], "who": ["o_custkey"]}


@query("SELECT * FROM (VALUES ('money', 'o_totalprice'), ('who', 'o_custkey'), ('combined', 'o_totalprice'), ('combined', 'o_custkey'), ('prices', 'o_totalprice')) t(modality, \"column\")")
def feature_groups(spark, d):
    df = read(spark, d, "orders")
    named = K.domains(["prices:price$", "none:^x"], df.columns)
    groups = K.modalities(df.columns, GROUPS, named, K.allowed_by_all({"o_totalprice", "o_custkey", "o_orderstatus"}, None, {"o_totalprice", "o_custkey", "o_orderdate"}), ["o_orderdate"])
    return spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "modality string, column string")


@query(f"""SELECT c AS "column", CASE c WHEN 'o_orderkey' THEN 'id' WHEN 'o_orderstatus' THEN 'outcome' WHEN 'o_orderdate' THEN 'time' WHEN 'o_orderpriority' THEN 'group' ELSE 'feature' END AS role,
c IN ('o_totalprice', 'o_orderstatus', 'o_custkey') AS included_as_candidate, CASE WHEN c IN ('o_totalprice', 'o_orderstatus') THEN 'money' WHEN c = 'o_custkey' THEN 'who' ELSE '' END AS modalities, usable AS numeric_usable,
c IN ('o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority') AS metadata_protected, false AS leakage_risk,
CASE WHEN c IN ('o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority') THEN 'metadata column protected from feature use' ELSE '' END AS leakage_reason FROM {LONG}""")
def column_audit(spark, d):
    return K.column_audit(read(spark, d, "orders"), ROLES, GROUPS)


@query("""WITH need(c, role, modalities) AS (VALUES ('o_custkey', 'feature', 'who'), ('o_orderdate', 'time', ''), ('o_orderkey', 'id', ''), ('o_orderpriority', 'group', ''), ('o_orderstatus', 'outcome', 'money'), ('o_totalprice', 'feature', 'money')),
dev AS (SELECT 'development' AS dataset, n.c, role, modalities, true AS present, l.usable AS numeric_usable FROM need n JOIN """ + LONG + """ l ON l.c = n.c),
ext AS (SELECT 'external', c, role, modalities, c IN ('o_orderkey', 'o_custkey', 'o_orderdate'), c IN ('o_orderkey', 'o_custkey') FROM need)
SELECT dataset, c AS "column", CASE WHEN c = 'o_orderstatus' THEN 'feature' ELSE role END AS role, modalities, present, numeric_usable, CASE WHEN dataset = 'external' AND NOT present AND c IN ('o_totalprice', 'o_orderstatus') THEN 'missing_external_feature' ELSE '' END AS issue
FROM (SELECT * FROM dev UNION ALL SELECT * FROM ext)""")
def schema_audit(spark, d):
    o = read(spark, d, "orders")
    return K.schema_audit(o, o.select("o_orderkey", "o_custkey", "o_orderdate"), ROLES, GROUPS)


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'holdout' ELSE 'development' END AS side, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def holdout_split(spark, d):
    sides = K.split_holdout(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    named = [df.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("side", F.lit(s)) for s, df in zip(("development", "holdout"), sides, strict=True)]
    return named[0].unionByName(named[1])


MARK = "CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN '?' END"


@query(f"""SELECT feature, c AS ibsi_compliant, CASE WHEN c THEN 'retained' ELSE 'rejected' END AS filter_decision, CASE WHEN c THEN 'IBSI compliant' ELSE 'not marked IBSI compliant' END AS reason
FROM (SELECT p_name || p_partkey AS feature, CASE {MARK} WHEN 'Yes' THEN true WHEN 'no' THEN false END AS c FROM part)""")
def metadata_filter(spark, d):
    return K.metadata_filter(read(spark, d, "part").select(F.concat("p_name", "p_partkey").alias("Feature"), F.expr(MARK).alias("IBSI")))


@query("""SELECT feature, CASE WHEN s >= 0.75 THEN 'retained' ELSE 'rejected' END AS filter_decision,
CASE WHEN s IS NULL THEN 'missing numeric robustness score' WHEN s >= 0.75 THEN 'all recorded robustness metrics met threshold' ELSE 'one or more recorded robustness metrics fell below threshold' END AS reason, s AS min_robustness_score
FROM (SELECT p_name || p_partkey AS feature, least(CASE WHEN p_partkey % 3 > 0 THEN p_size / 50.0::DOUBLE END, CASE WHEN p_partkey % 5 > 0 THEN 0.7 + p_size / 100.0::DOUBLE END) AS s FROM part)""")
def robustness_filter(spark, d):
    icc, ccc = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") / 50.0), F.when(F.col("p_partkey") % 5 > 0, 0.7 + F.col("p_size") / 100.0)
    return K.robustness_filter(read(spark, d, "part").select(F.concat("p_name", "p_partkey").alias("variable"), icc.alias("icc"), ccc.alias("ccc")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS segment, split_part(b, '_', 1) AS image_type, split_part(b, '_', 2) AS feature_class, coalesce(array_to_string(list_slice(string_split(b, '_'), 3, 99), '_'), '') AS feature_name
FROM (SELECT *, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_a_b' ELSE '' END AS b FROM part)""")
def feature_names(spark, d):
    base = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, "_a_b").otherwise(""))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("__"), base)).otherwise(base)
    return read(spark, d, "part").select("p_partkey", K.feature_parts(name).alias("f")).select("p_partkey", "f.*")


REGISTRY = [K.Metric("o_totalprice", "money", ("all", "cost"), 0.0), K.Metric("o_custkey", "who", ("all",)), K.Metric("discount", "money", ("cost",), 0.0)]


@query("SELECT * FROM (VALUES ('o_totalprice', 'money', true, true), ('o_custkey', 'who', true, false), ('discount', 'money', false, true)) t(feature, domain, \"all\", cost)")
def set_membership(spark, d):
    return K.membership(spark, REGISTRY)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, 0) AS o_totalprice, 0.0::DOUBLE AS discount FROM orders")
def registered_defaults(spark, d):
    holes = read(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    return K.subset(K.with_defaults(holes, REGISTRY), REGISTRY, "cost", ["o_orderkey"])


@query(f"""SELECT * FROM (VALUES ('compact', 'o_totalprice'), ('preferred', 'o_orderpriority')) t(rule, "column") UNION ALL
SELECT 'numeric', CASE WHEN s THEN 'o_orderstatus' WHEN t THEN 'o_totalprice' END FROM (SELECT {NUMBER.format(c='o_orderstatus')} AS s, {NUMBER.format(c='o_totalprice')} AS t FROM orders)""")
def found_columns(spark, d):
    o = read(spark, d, "orders")
    rows = [("compact", K.find_column(o.columns, ["total", "price"])), ("preferred", K.find_column(o.columns, ["order"], ["key"], ["prior"])), ("numeric", K.first_numeric_column(o, ["absent", "o_orderstatus", "o_totalprice", "o_custkey"]))]
    return spark.createDataFrame(rows, "rule string, column string")


WORD = "CASE c_custkey % 6 WHEN 0 THEN 'Event' WHEN 1 THEN ' Censored ' WHEN 2 THEN '2' WHEN 3 THEN '0' WHEN 4 THEN 'later' END"


@query(f"""SELECT c_custkey, coalesce(TRY_CAST(w AS DOUBLE), 0) >= 1 AS by_number, coalesce(lower(w) IN ('1','true','yes','event'), false) AS by_word, coalesce(w = '2', false) AS competing,
lower(trim(coalesce(w, ''))) IN ('','0','false','no','none','nan','censor','censored') AS censored_word, lower(trim(coalesce(w, ''))) IN ('','0','false','no','none','nan','censor','censored') OR coalesce(TRY_CAST(w AS DOUBLE), 0) = 0 AS censored_number
FROM (SELECT c_custkey, {WORD} AS w FROM customer)""")
def event_rules(spark, d):
    w = F.expr(WORD)
    return read(spark, d, "customer").select("c_custkey", O.event(w, True).alias("by_number"), O.event(w, False).alias("by_word"), O.event(w, False, "2").alias("competing"), O.censored(w, False).alias("censored_word"), O.censored(w, True).alias("censored_number"))


@query("""SELECT c_custkey, CASE WHEN trim(cause) = '2' OR trim(cv) <> '' THEN 1 WHEN trim(fu) = '0' THEN 0 WHEN trim(dod) <> '' OR trim(fu) = '1' THEN 0 END AS flag FROM (
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' 2' WHEN 1 THEN '1' END AS cause, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE ' ' END AS cv, CASE WHEN c_custkey % 5 = 0 THEN '2020' END AS dod, CASE c_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1 ' END AS fu FROM customer)""")
def death_flags(spark, d):
    k = F.col("c_custkey")
    cause, cv = F.when(k % 4 == 0, " 2").when(k % 4 == 1, "1"), F.when(k % 7 == 0, "x").otherwise(" ")
    return read(spark, d, "customer").select("c_custkey", O.cardiovascular_death(cause, cv, F.when(k % 5 == 0, "2020"), F.when(k % 3 == 0, "0").when(k % 3 == 1, "1 ")).alias("flag"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS subject FROM part")
def subject_ids(spark, d):
    case = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sub-00"), F.col("p_partkey").cast("string"), F.lit("_ct_1"))).otherwise(F.concat(F.lit("sub-"), "p_brand", F.lit("_x")))
    return read(spark, d, "part").select("p_partkey", O.subject_id(case).alias("subject"))


@query("SELECT o_orderkey AS patient_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS ROI, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2")
def normalized_input(spark, d):
    raw = read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit(" "), "o_orderstatus").alias("region"), F.when(F.col("o_orderpriority") == "5-LOW", "Success").otherwise("failed").alias("status"))
    out = O.normalized(raw, {"patient_id": ("patient_id", "case_id"), "ROI": ("ROI", "roi", "region")}, {"o": "open", "f": "final"}, "ROI")
    return out.groupBy("patient_id", "ROI").agg(F.count("*").alias("n"))


MEANS = """SELECT l_orderkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r, avg(l_tax) AS t FROM lineitem GROUP BY 1"""


def means(spark, d):
    q = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(q("A").alias("a"), q("N").alias("n"), q("R").alias("r"), F.avg("l_tax").alias("t"))


@query(f"""SELECT l_orderkey, round(a / nullif(n, 0), 6) AS a_n, round(r / nullif(a, 0), 6) AS r_a, round(a / nullif(t, 0), 6) AS a_t, round(a - n, 6) AS a_less_n, round(r / 1000, 6) AS r_thousand,
CASE WHEN a * 8 >= 250 THEN 'high_hu_like_normal_opacification' WHEN a * 8 <= 150 THEN 'low_hu_like_filling_defect' ELSE 'intermediate_hu' END AS pattern,
CASE WHEN r / a > 1.5 THEN 'very_early_right_dominant' WHEN a / n > 1.5 AND a / r > 1 THEN 'arterial' WHEN a / n BETWEEN 0.8 AND 1.2 THEN 'mildly_delayed' ELSE 'unclassified' END AS phase FROM ({MEANS})""")
def derived_measures(spark, d):
    df = O.derived(means(spark, d), {"a_n": ("a", "n"), "r_a": ("r", "a"), "a_t": ("a", "t"), "a_r": ("a", "r")}, {"a_less_n": ("a", "n")}, {"r_thousand": ("r", 1000.0)})
    df = df.withColumns({"pattern": O.enhancement(F.col("a") * 8), "phase": O.contrast_phase(F.col("a_n"), F.col("r_a"), F.col("a_r"))})
    return rounded(df.drop("a", "n", "r", "t", "a_r"), ("a_n", "r_a", "a_t", "a_less_n", "r_thousand"))


@query(f"""WITH m AS ({MEANS}), x AS (SELECT l_orderkey, coalesce(a, n) AS u, t AS w FROM m), s AS (SELECT avg(u) AS mu, stddev_pop(u) AS su, avg(w) AS mw, stddev_pop(w) AS sw FROM x)
SELECT l_orderkey, round(CASE WHEN u IS NULL THEN (w - mw) / sw ELSE ((u - mu) / su + (w - mw) / sw) / 2 END, 5) + 0.0 AS proxy FROM x, s""")
def proxy_scores(spark, d):
    return O.proxy_scores(means(spark, d), {"proxy": [("a", "n"), ("t", "absent")]}).select("l_orderkey", (F.round("proxy", 5) + 0.0).alias("proxy"))


@query("""SELECT p_partkey, round(p_retailprice / nullif(p_size, 0), 6) AS ratio__p_retailprice__per_volume, round(p_retailprice / nullif(l, 0), 6) AS ratio__p_retailprice__per_length,
round(w / nullif(r, 0), 6) AS ratio__w__per_radius, round(w / nullif(r * 2, 0), 6) AS ratio__w__per_diameter FROM (SELECT *, CASE WHEN p_size / nullif(l * 10, 0) > 0 THEN sqrt(p_size / (l * 10) / pi()) END AS r FROM (SELECT *, p_partkey % 5::DOUBLE AS l, p_partkey % 11::DOUBLE AS w FROM part))""")
def size_ratios(spark, d):
    df = read(spark, d, "part").withColumns({"l": (F.col("p_partkey") % 5).cast("double"), "w": (F.col("p_partkey") % 11).cast("double")})
    out = O.size_ratios(df, ["p_retailprice"], "p_size", "l", ["w"])
    names = [c for c in out.columns if c.startswith("ratio__")]
    return rounded(out.select("p_partkey", *names), names)


@query("""WITH r AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS record, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ct' ELSE '' END AS instrument, strftime(o_orderdate, '%Y-%m-%d') AS scanned, CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS onset FROM orders),
p AS (SELECT record, arg_max(struct_pack(o_orderkey := o_orderkey, onset := onset), o_orderkey) AS s FROM r WHERE instrument = '' AND trim(record) <> '' GROUP BY 1), f AS (SELECT record, min(scanned) AS scan_first FROM r GROUP BY 1)
SELECT p.record, s.o_orderkey AS o_orderkey, coalesce(s.onset, scan_first) AS index_date, CASE WHEN s.onset IS NOT NULL THEN 'onset' ELSE 'scan' END AS index_source FROM p JOIN f USING (record)""")
def repeating_records(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = read(spark, d, "orders").select(F.when(F.col("o_custkey") % 10 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("record"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "ct").otherwise("").alias("instrument"), F.lit(None).cast("string").alias("instance"), day.alias("scanned"), F.when(F.col("o_orderpriority") == "5-LOW", day).alias("onset"))
    out = O.repeating_records(rows, "record", "instrument", "instance", "scanned", "o_orderkey", "onset")
    return out.select("record", "o_orderkey", F.date_format("index_date", "yyyy-MM-dd").alias("index_date"), "index_source")


@query("SELECT (SELECT min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)) AS first_pending, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)) AS n_pending")
def pending_work(spark, d):
    o, done = read(spark, d, "orders"), read(spark, d, "customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("o_custkey"))
    return O.first_pending(o, "o_orderkey", "o_custkey", done).crossJoin(O.pending(o, "o_custkey", done).agg(F.count("*").alias("n_pending")))  # one row each


@query("""WITH c AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS p, avg(o_custkey) AS k FROM orders GROUP BY 1), d AS (SELECT o_orderstatus, o_orderkey, sqrt(power(o_totalprice - p, 2) + power(o_custkey - k, 2)) AS x FROM orders JOIN c ON s = o_orderstatus)
SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY x, o_orderkey) AS rank, o_orderkey FROM d QUALIFY rank <= 3""")
def representative_rows(spark, d):
    return O.representatives(read(spark, d, "orders"), "o_orderkey", "o_orderstatus", ["o_totalprice", "o_custkey"], 3).select("o_orderstatus", "rank", "o_orderkey")


@query("""WITH c AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS p FROM orders GROUP BY 1), r AS (SELECT o_orderkey FROM orders JOIN c ON s = o_orderstatus QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs(o_totalprice - p), o_orderkey) <= 1)
SELECT 'listed' AS rule, o_orderkey FROM orders WHERE o_orderkey IN (7, 3) UNION ALL SELECT 'head', o_orderkey FROM orders WHERE o_orderkey < 2 UNION ALL SELECT 'near', o_orderkey FROM r""")
def chosen_cases(spark, d):
    o = read(spark, d, "orders")
    near = O.representatives(o, "o_orderkey", "o_orderstatus", ["o_totalprice"], 1).select("o_orderkey", "rank")
    pick = lambda rule, *a: O.chosen_cases(o, "o_orderkey", *a).select(F.lit(rule).alias("rule"), "o_orderkey")
    return pick("listed", [7, 3, -1], None, 5).union(pick("head", [], None, 2)).union(pick("near", [], near, 5))


@query("""WITH r AS (SELECT o_orderstatus, o_orderpriority, max(o_totalprice) - min(o_totalprice) AS x FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY x DESC, o_orderpriority) <= 3)
SELECT o_orderpriority, round(max(x), 4) AS max_range, round(avg(x), 4) AS mean_range, count(*) AS n_runs, arg_max(o_orderstatus, x) AS best_run FROM r GROUP BY 1""")
def range_ranking(spark, d):
    return rounded(O.spread_ranking(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", 3), ("max_range", "mean_range"), 4)


@query("""SELECT event_id, v AS value FROM (SELECT event_id, unnest([CAST(props->>'k' AS VARCHAR), event_type, CAST(user_id AS VARCHAR)]) AS v FROM events WHERE event_id % 10 < 9)""")
def flattened_json(spark, d):
    nested = F.format_string('{"a": %s, "b": [{"c": "%s"}, [%d, null]], "e": {}}', "props", "event_type", "user_id")
    return O.flattened(read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 9, "{no json").otherwise(nested).alias("j")), ["event_id"], "j")
