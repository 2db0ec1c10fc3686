"""Queries over records: building, validating, transforming and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import records as K
from quarry.plans.base import query, table


@query("k1_query_builder", "SELECT c_mktsegment, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer INNER JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY c_mktsegment, n_name HAVING count(*) > 2 ORDER BY c_mktsegment, n_name LIMIT 1000 OFFSET 5")
def k1(spark, sf_dir):
    built = (
        K.QueryBuilder()
        .select("c_mktsegment", "n_name", "count(*) AS customers", "round(sum(c_acctbal), 2) AS balance")
        .from_("k1_customer")
        .join("k1_nation", "c_nationkey = n_nationkey")
        .where("c_acctbal > :least", least=0)
        .group_by("c_mktsegment", "n_name")
        .having("count(*) > :few", few=2)
        .order_by("c_mktsegment", "n_name")
        .limit(1000, 5)
    )
    return built.run(spark, k1_customer=table(spark, sf_dir, "customer"), k1_nation=table(spark, sf_dir, "nation"))


@query("k2_parameterised_sql", "SELECT o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 4) AS average FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus")
def k2(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("k2_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 4) AS average FROM k2_orders WHERE o_orderpriority = :p GROUP BY o_orderstatus", args={"p": "1-URGENT"})


@query("k3_update_delete", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def k3(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where(~F.coalesce(F.col("c_mktsegment") == "MACHINERY", F.lit(False)))
    return rows.select("c_custkey", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


@query("k4_table_counts", "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def k4(spark, sf_dir):
    parts = [table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("region", "nation", "customer", "orders")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("k6_find_by_id", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def k6(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("k9_validators", r"SELECT c_custkey, regexp_matches(c_name || '@shop.example', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_ok, regexp_matches('555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), '^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$') AS phone_ok, coalesce(c_acctbal BETWEEN 0 AND 5000, false) AS range_ok FROM customer")
def k9(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", K.is_email(F.concat("c_name", F.lit("@shop.example"))).alias("email_ok"), K.is_phone(F.concat(F.lit("555"), F.lpad(key, 7, "0"))).alias("phone_ok"), K.in_range(F.col("c_acctbal"), 0, 5000).alias("range_ok"))


@query("k9_date_range", "SELECT o_orderkey, coalesce(o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31', false) AS date_ok FROM orders")
def k9_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.in_dates(F.col("o_orderdate").cast("string"), "1995-01-01", "1996-12-31").alias("date_ok"))


@query("k10_text_transform", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents")
def k10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(K.clean_text(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query("k10_keywords", r"WITH w AS (SELECT source, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g'), '[ \t\n\r\f\x0B]+'), lambda w: length(w) > 5)) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY source, word) SELECT source, word, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM c) WHERE r <= 10")
def k10_keywords(spark, sf_dir):
    from quarry.operators.graph import rank_within

    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9\s]", ""), r"[ \t\n\r\f\x0B]+"), lambda w: F.length(w) > 5)
    counted = table(spark, sf_dir, "documents").select("source", F.explode(words).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    return rank_within(counted, "source", [F.desc("n"), F.asc("word")], 10).select("source", "word", "n")


@query("k11_min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS normalised FROM customer")
def k11(spark, sf_dir):
    return K.min_max(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", F.round("normalised", 6).alias("normalised"))


@query("k11_statistics", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count FROM lineitem GROUP BY l_returnflag")
def k11_statistics(spark, sf_dir):
    stats = K.number_statistics(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return stats.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std")), "min", "max", "count")


@query("k12_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(2000 - year(o_orderdate) - CASE WHEN month(o_orderdate) > 6 OR (month(o_orderdate) = 6 AND day(o_orderdate) > 15) THEN 1 ELSE 0 END AS BIGINT) AS age FROM orders")
def k12(spark, sf_dir):
    age = K.full_years(F.to_date("o_orderdate"), F.lit("2000-06-15").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), age.alias("age"))


@query("k13_registry", "SELECT c_custkey, lower(trim(c_name)) AS c_name, concat_ws('; ', CASE WHEN NOT coalesce(c_acctbal BETWEEN 0 AND 9000, false) THEN 'c_acctbal: range' END, CASE WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'AUTOMOBILE'), false) THEN 'c_mktsegment: known' END) AS errors FROM customer")
def k13(spark, sf_dir):
    registry = K.Registry({"lower": lambda c: F.lower(F.trim(c))}, {"range": lambda c: K.in_range(c, 0, 9000), "known": lambda c: c.isin("BUILDING", "AUTOMOBILE")})
    done = registry.process(table(spark, sf_dir, "customer"), {"c_name": "lower"}, {"c_acctbal": "range", "c_mktsegment": "known"})
    return done.select("c_custkey", "c_name", F.array_join("errors", "; ").alias("errors"))


@query("k13_valid_split", "SELECT coalesce(c_acctbal BETWEEN 0 AND 9000, false) AS valid, count(*) AS n FROM customer GROUP BY 1")
def k13_split(spark, sf_dir):
    registry = K.Registry({}, {"range": lambda c: K.in_range(c, 0, 9000)})
    done = registry.process(table(spark, sf_dir, "customer"), {}, {"c_acctbal": "range"})
    both = registry.valid(done).select(F.lit(True).alias("valid")).union(registry.invalid(done).select(F.lit(False)))
    return both.groupBy("valid").agg(F.count("*").alias("n"))


_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("k14_profile", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round(count({c}) / count(*), 6) AS completeness FROM customer" for c in _COLUMNS))
def k14(spark, sf_dir):
    return K.profile(table(spark, sf_dir, "customer").select(*_COLUMNS)).withColumn("completeness", F.round("completeness", 6))


_LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN k % 2 = 0 THEN CASE WHEN CAST(substring(reverse(n), k, 1) AS INTEGER) * 2 > 9 THEN CAST(substring(reverse(n), k, 1) AS INTEGER) * 2 - 9 ELSE CAST(substring(reverse(n), k, 1) AS INTEGER) * 2 END ELSE CAST(substring(reverse(n), k, 1) AS INTEGER) END))"


@query("k16_luhn", f"WITH c AS (SELECT c_custkey, CAST(4000000000000000 + c_custkey * 7919 AS VARCHAR) AS n FROM customer) SELECT c_custkey, {_LUHN} % 10 = 0 AS card_ok FROM c")
def k16(spark, sf_dir):
    number = (F.lit(4000000000000000) + F.col("c_custkey") * 7919).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", K.luhn(number).alias("card_ok"))


@query("k16_script_strip", r"SELECT page_id, length(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g')) AS n_chars, md5(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g')) AS digest FROM pages")
def k16_scripts(spark, sf_dir):
    clean = K.strip_scripts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"))


@query("k16_form_checks", r"SELECT s_suppkey, regexp_matches(s_name, '^[a-zA-Z]+$') AS name_ok, regexp_matches('555-010-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), '^\d{3}-\d{3}-\d{4}$') AS phone_ok, CAST(CASE WHEN length(s_name) >= 8 THEN 1 ELSE 0 END + CASE WHEN length(s_name) >= 12 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s_name, '[a-z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s_name, '[A-Z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s_name, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s_name, '[^a-zA-Z0-9]') THEN 1 ELSE 0 END AS INTEGER) AS strength FROM supplier")
def k16_forms(spark, sf_dir):
    name = F.col("s_name")
    phone = F.concat(F.lit("555-010-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.rlike(K.USER_NAME).alias("name_ok"), phone.rlike(K.FORM_PHONE).alias("phone_ok"), K.password_strength(name).alias("strength"))


@query("k17_text_utilities", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(p_type) <= 12 THEN p_type ELSE substring(p_type, 1, 9) || '...' END AS short, sha256(p_name) AS digest FROM part")
def k17(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"), K.shortened(F.col("p_type"), 12).alias("short"), F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"))


@query("k18_flatten", "SELECT o_orderkey AS \"o.key\", o_orderstatus AS \"o.state.status\", o_totalprice AS \"o.state.price\" FROM orders")
def k18(spark, sf_dir):
    nested = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("state"))
    return K.flattened(table(spark, sf_dir, "orders").select(nested.alias("o")))


@query("k18_slices", "WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(ceil(len(x) / 4.0) AS INTEGER) AS slices, array_to_string(x[1:4], ',') AS first_slice FROM l")
def k18_slices(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    cut = lists.withColumn("s", K.sliced(F.col("x"), 4))
    return cut.select("o_custkey", F.size("s").alias("slices"), F.array_join(F.transform(F.get("s", F.lit(0)), lambda v: v.cast("string")), ",").alias("first_slice"))


@query("k18_merge_maps", "SELECT n_nationkey, 'a' || n_nationkey AS own, CAST(n_regionkey AS VARCHAR) AS region, 'x' AS base FROM nation")
def k18_maps(spark, sf_dir):
    base = F.create_map(F.lit("own"), F.lit("?"), F.lit("base"), F.lit("x"))
    more = F.create_map(F.lit("own"), F.concat(F.lit("a"), "n_nationkey"), F.lit("region"), F.col("n_regionkey").cast("string"))
    merged = table(spark, sf_dir, "nation").select("n_nationkey", K.merged_maps(base, more).alias("m"))
    return merged.select("n_nationkey", *(F.col("m")[k].alias(k) for k in ("own", "region", "base")))


@query("k20_priority_queue", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders")
def k20(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query("k21_salted_digest", "SELECT c_custkey, sha256(c_name || 'salt' || c_custkey) AS digest, c_mktsegment = 'BUILDING' AS has_role FROM customer")
def k21(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat("c_name", F.lit("salt"), "c_custkey").cast("binary"), 256).alias("digest"), (F.col("c_mktsegment") == "BUILDING").alias("has_role"))


@query("k22_bounded_history", "SELECT o_custkey, count(*) AS kept, round(avg(o_totalprice), 4) AS average FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5 GROUP BY o_custkey")
def k22(spark, sf_dir):
    from quarry.operators.graph import rank_within

    last = rank_within(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return last.groupBy("o_custkey").agg(F.count("*").alias("kept"), F.round(F.avg("o_totalprice"), 4).alias("average"))
