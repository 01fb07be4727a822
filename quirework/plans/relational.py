"""Relational queries over the star schema. Spark's own operators cover these; each query shows the plan to ask for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, intervals, sketches
from ..shared import written
from .tables import table


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Customers are counted per key before the join, so the join sees one row a nation.
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    n = table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers")


def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"))
    j = d.join(q, F.col("doc_id") == F.col("l_id"), "full")
    return j.groupBy().agg(F.count_if(F.col("l_id").isNull()).alias("unlabelled"), F.count_if(F.col("doc_id").isNull()).alias("undocumented"), F.count("*").alias("n"))


def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    tag = lambda how: d.join(q, "doc_id", f"left_{how}").groupBy("lang").agg(F.count("*").alias("n")).withColumn("how", F.lit(how))
    return tag("semi").unionByName(tag("anti"))


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in bands of size: each band key is computed, so the range join is an equi-join."""
    bands = spark.createDataFrame([(k, 1 + 10 * k, 10 + 10 * k) for k in range(5)], "band int, low int, high int")
    p = table(spark, sf_dir, "part").withColumn("band", F.floor((F.col("p_size") - 1) / 10).cast("int"))
    return p.join(bands, "band").where("p_size BETWEEN low AND high").groupBy("band", "low", "high").agg(F.count("*").alias("parts"))


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up at or before each purchase of a user: both in one ordered history, so no pairs are made."""
    signup = F.col("event_type") == "signup"
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')").select("event_id", "user_id", "ts", "event_type", F.when(signup, 0).otherwise(1).alias("turn"))
    out = history.filled(e, "user_id", ["ts", "turn", "event_id"], F.when(signup, F.col("event_id")), "signup_id")
    return out.where("event_type = 'purchase'").select("event_id", "signup_id")


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user within ten minutes after an error: equi-join on user and ten-minute bucket, then the exact test."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    size = 600 * 1_000_000
    a = e.where("event_type = 'error'").select("user_id", F.col("s").alias("from"), F.explode(F.array(F.floor(F.col("s") / size), F.floor(F.col("s") / size) + 1)).alias("bucket"))
    b = e.where("event_type = 'click'").select("user_id", "event_id", "s", F.floor(F.col("s") / size).alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where((F.col("s") >= F.col("from")) & (F.col("s") <= F.col("from") + size)).groupBy("user_id").agg(F.count("*").alias("pairs"), F.countDistinct("event_id").alias("clicks"))


def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases of a user as intervals of unequal widths, from moments to two weeks: how many pairs overlap, and how many purchases are in one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    k = F.col("event_id") % 7
    a = e.where("event_type = 'error'").select("user_id", F.col("at").alias("a_low"), (F.col("at") + k * k * k * 3600).alias("a_high"))
    b = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("b_low"), (F.col("at") + F.col("event_id") % 5 * 600).alias("b_high"))
    return intervals.overlapping(a, b, ("a_low", "a_high"), ("b_low", "b_high"), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("pairs"), F.countDistinct("event_id").alias("purchases"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("price").alias("price"))
    return j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("price", 2).alias("revenue"))


def grouping_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("gid"))
    return d.select("lang", "source", "n", "chars", "gid")


def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


def distinct_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median_qty"))


def sketch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days answered from daily sketches: exact numbers of users, and whether the estimates of users and of the median value keep their bounds."""
    e = table(spark, sf_dir, "events").select("ts", "event_type", "user_id", "value")
    kept = written(sketches.daily(e, "ts", ["event_type"], "user_id", "value"), "sketches")
    day = e.agg(F.to_date(F.min("ts")).alias("low"), F.to_date(F.max("ts")).alias("high"))
    ranges = written(day.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), first.alias("first"), last.alias("last")) for n, first, last in (
        ("week", F.col("low"), F.date_add("low", 6)), ("from the tenth", F.date_add("low", 9), F.col("high")), ("all", F.col("low"), F.col("high")))]))), "ranges")
    told = written(sketches.over(kept, ranges, ["event_type"]).select("name", "event_type", "keys", F.col("values")[0].alias("median")), "told")
    rows = e.withColumn("day", F.to_date("ts")).join(F.broadcast(ranges), F.col("day").between(F.col("first"), F.col("last"))).join(F.broadcast(told), ["name", "event_type"])
    exact = rows.groupBy("name", "event_type").agg(F.countDistinct("user_id").alias("users"), F.first("keys").alias("keys"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("above"), F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"))
    near = (F.col("below") <= 0.5 + sketches.RANK_BOUND) & (F.col("above") >= 0.5 - sketches.RANK_BOUND)
    return exact.select("name", "event_type", "users", (F.abs(F.col("keys") - F.col("users")) <= 1 + sketches.DISTINCT_BOUND * F.col("users")).alias("users_within"), near.alias("median_within"))


def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("sum3"), F.lag("event_type").over(w).alias("before"), F.round(F.first("value").over(w), 4).alias("first_value"))


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each priority: a top-k report."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_orderpriority", "o_orderkey", F.col("rn").cast("long").alias("rn"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    tag = lambda df, how: df.withColumn("how", F.lit(how))
    return tag(d.intersect(q), "intersect").unionByName(tag(d.subtract(q), "except")).unionByName(tag(d.union(q).distinct(), "union"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def array_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 5).alias("norm"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id")).fillna(0)


def udf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function and a grouped one over Arrow: mean price by brand, and its spread."""
    @F.arrow_udf("double")
    def with_tax(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        for part in parts:
            yield pc.multiply(part, 1.1)

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    p = table(spark, sf_dir, "part").select("p_brand", with_tax("p_retailprice").alias("taxed"))
    return p.groupBy("p_brand").agg(spread("taxed").alias("s")).select("p_brand", F.round("s", 4).alias("spread"))


def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function that gives a row for each part of a name."""
    @F.udtf(returnType="part string, place int")
    class Parts:
        def eval(self, name: str):
            for i, part in enumerate((name or "").split()):
                yield part, i

    words = table(spark, sf_dir, "part").select("p_name").lateralJoin(Parts(F.col("p_name").outer()))
    return words.groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("part").alias("words"))


QUERIES = {f.__name__: f for f in (
    join_inner, join_full, join_semi_anti, join_range, join_asof, join_interval, join_overlap, pricing_summary, revenue_by_nation, grouping_cube, grouping_rollup, grouping_sets, distinct_counts,
    distinct_approximate, sketch_ranges, window_functions, top_per_group, set_operations, json_fields, array_norms, sliding_windows, pivot_counts, udf_kinds, udtf_words,
)}

SQL = {
    "join_inner": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS undocumented, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "join_semi_anti": "SELECT lang, count(*) AS n, 'semi' AS how FROM documents SEMI JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT lang, count(*), 'anti' FROM documents ANTI JOIN labels USING (doc_id) GROUP BY lang",
    "join_range": "SELECT CAST(k AS INT) AS band, CAST(1 + 10 * k AS INT) AS low, CAST(10 + 10 * k AS INT) AS high, count(*) AS parts FROM part JOIN range(0, 5) b(k) ON p_size BETWEEN 1 + 10 * k AND 10 + 10 * k GROUP BY k",
    "join_asof": "SELECT p.event_id, (SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts) AS signup_id FROM events p WHERE p.event_type = 'purchase'",
    "join_overlap": """
        WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS t FROM events)
        SELECT a.user_id, count(*) AS pairs, count(DISTINCT b.event_id) AS purchases FROM e a JOIN e b ON a.user_id = b.user_id AND a.t <= b.t + b.event_id % 5 * 600 AND b.t <= a.t + (a.event_id % 7) ** 3 * 3600
        WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY a.user_id""",
    "join_interval": "SELECT a.user_id, count(*) AS pairs, count(DISTINCT b.event_id) AS clicks FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTES WHERE a.event_type = 'error' AND b.event_type = 'click' GROUP BY a.user_id",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "grouping_cube": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang, source) AS BIGINT) AS gid FROM documents GROUP BY CUBE (lang, source)",
    "grouping_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "sketch_ranges": """
        WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST((SELECT min(ts) FROM events) AS DATE) AS low FROM events), r AS (
            SELECT 'week' AS name, * FROM e WHERE day <= low + 6 UNION ALL SELECT 'from the tenth', * FROM e WHERE day >= low + 9 UNION ALL SELECT 'all', * FROM e
        )
        SELECT name, event_type, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within FROM r GROUP BY name, event_type""",
    "distinct_counts": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type",
    "window_functions": "SELECT event_id, row_number() OVER w AS rn, ntile(4) OVER w AS quarter, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum3, lag(event_type) OVER w AS before, round(first_value(value) OVER w, 4) AS first_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "top_per_group": "SELECT o_orderpriority, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "set_operations": "(SELECT doc_id, 'intersect' AS how FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'except' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'union' FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels))",
    "json_fields": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type",
    "array_norms": "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS norm FROM embeddings GROUP BY label",
    "sliding_windows": "SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day FROM events) GROUP BY 1, 2",
    "pivot_counts": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "udtf_words": "SELECT CAST(i - 1 AS INT) AS place, count(*) AS n, count(DISTINCT w[i]) AS words FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '') AS w FROM part)) GROUP BY i",
    "udf_kinds": "SELECT p_brand, round(max(p_retailprice * 1.1) - min(p_retailprice * 1.1), 4) AS spread FROM part GROUP BY p_brand",
}
