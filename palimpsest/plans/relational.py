"""Relational and streaming queries over the star schema and the events. These are additions: the documents come first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.plans.catalogue import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return held.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count("*").alias("n"))


@query("orders_by_nation", "SELECT n_name, count(*)::BIGINT AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    by_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"))  # before the join: a row for each customer
    return by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n_orders"))


@query("customers_without_large_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("flag_cube", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def flag_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("top_orders", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("parts_in_both", "SELECT l_partkey AS partkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def parts_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_quantity > 40").select(F.col("l_partkey").alias("partkey")).intersect(li.where("l_discount > 0.05").select(F.col("l_partkey").alias("partkey")))


@query(
    "event_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.streaming.events import hourly

    return hourly(table(spark, sf_dir, "events"))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, (max(k) + 1)::BIGINT AS n_sessions, count(*)::BIGINT AS n_events FROM s GROUP BY user_id""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) > 30 * 60 * 1_000_000
    held = table(spark, sf_dir, "events").select("user_id", F.when(late, 1).otherwise(0).alias("b"))
    return held.groupBy("user_id").agg((F.sum("b") + 1).alias("n_sessions"), F.count("*").alias("n_events"))


@query("event_as_of", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def event_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the value of the user's latest event of type purchase so far: a window instead of a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


@query(
    "orders_in_price_bands",
    "WITH b AS (SELECT r_regionkey AS band, r_regionkey * 100000.0 AS low, (r_regionkey + 1) * 100000.0 AS high FROM region) SELECT band, count(*)::BIGINT AS n FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY band",
)
def orders_in_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: a price to the band that holds it. Bands are as many as regions, and so are broadcast."""
    bands = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("band"), (F.col("r_regionkey") * 100000.0).alias("low"), ((F.col("r_regionkey") + 1) * 100000.0).alias("high"))
    return table(spark, sf_dir, "orders").join(bands, (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("n"))


@query("nation_pairs", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta join: an equality, which partitions, and an inequality."""
    n = table(spark, sf_dir, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("region_segments", "SELECT r_name, seg AS segment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def region_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross join of two small dimensions: regions, and the segments that occur."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return table(spark, sf_dir, "region").select("r_name").crossJoin(segments)


@query("customers_with_urgent_orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_with_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("nations_either_side", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < -500 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT coalesce(c.k, s.k)::BIGINT AS nation, c.n AS n_customers, s.n AS n_suppliers FROM c FULL JOIN s ON c.k = s.k")
def nations_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal < -500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nation", "full_outer").select(F.col("nation").cast("long").alias("nation"), "n_customers", "n_suppliers")


@query("orders_right_outer", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def orders_right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("sales_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("long").alias("level"))


@query("sales_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def sales_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ordered_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort with a limit and an offset: the ranks 11 to 35, taken map-side first."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("customers_sorted", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer")
def customers_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global sort without a single task: ranges are sorted apart, and each row's place is its range's start and its own."""
    ranged = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").repartitionByRange("c_mktsegment", F.desc("c_acctbal"), "c_custkey").withColumn("part", F.spark_partition_id())
    starts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey"))
    return ranged.withColumn("own", own).join(before, "part").select("c_custkey", (F.col("before") + F.col("own")).alias("place"))


@query("parts_union", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 50 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def parts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("k")).union(table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")).distinct()


@query("parts_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def parts_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select("l_partkey"))


@query("approximate_close", "SELECT true AS distinct_is_close, true AS median_is_close")
def approximate_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against the exact figures, within their stated errors."""
    li = table(spark, sf_dir, "lineitem")
    a = li.agg(F.approx_count_distinct("l_partkey", 0.02).alias("d"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("m"), F.count_distinct("l_partkey").alias("exact"), F.median("l_extendedprice").alias("median"))
    return a.select((F.abs(F.col("d") - F.col("exact")) <= 0.1 * F.col("exact")).alias("distinct_is_close"), (F.abs(F.col("m") - F.col("median")) <= 0.01 * F.col("median")).alias("median_is_close"))


@query("order_dates", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS later, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS days FROM orders")
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.trunc(d.cast("date"), "quarter").cast("string").alias("q"), F.add_months(d.cast("date"), 3).cast("string").alias("later"), F.date_diff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read into a typed struct, and written from one."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("made"))


@query("event_variant", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def event_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("event_type", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return held.groupBy("event_type").agg(F.sum("k").alias("total"))


@query(
    "event_sliding",
    "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - (30 * k) * INTERVAL 1 MINUTE AS window_start, event_type FROM events, range(2) AS t(k)) SELECT window_start, event_type, count(*)::BIGINT AS n FROM w GROUP BY ALL",
)
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.streaming.events import sliding

    return sliding(table(spark, sf_dir, "events"))


@query(
    "event_session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""",
)
def event_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events"))


@query("weighted_price", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_returnflag")
def weighted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate. Arrow batches are summed map-side to one row a batch and group, so no group is collected."""
    from collections.abc import Iterator

    import pyarrow as pa

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            t = pa.table({"flag": batch.column(0), "vw": pc.multiply(batch.column(1), batch.column(2)), "w": batch.column(2)})
            g = t.group_by("flag").aggregate([("vw", "sum"), ("w", "sum")])
            yield from g.select(["flag", "vw_sum", "w_sum"]).rename_columns(["l_returnflag", "vw", "w"]).to_batches()

    sums = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity").mapInArrow(partial, "l_returnflag string, vw double, w double")
    return sums.groupBy("l_returnflag").agg(F.round(F.sum("vw") / F.sum("w"), 4).alias("weighted"))


@query("word_places", "SELECT item_id, unnest(range(len(w)))::BIGINT AS at, unnest(w) AS word FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined table function, joined laterally to each row."""

    @F.udtf(returnType="at: bigint, word: string")
    class Words:
        def eval(self, text: str):  # noqa: ANN202
            for at, word in enumerate((text or "").split(" ")):
                yield at, word

    spark.udtf.register("palimpsest_words", Words)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("palimpsest_benchmark")
    return spark.sql("SELECT item_id, w.at, w.word FROM palimpsest_benchmark, LATERAL palimpsest_words(text) w")


@query("print_code_table", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'u' WHEN 2 THEN 'b' END AS style FROM customer")
def print_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter table as an input: codes and what they mean, a few rows, joined to rows that name a code."""
    codes = spark.createDataFrame([(0, "i"), (1, "u"), (2, "b")], "code int, style string")
    held = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("code"))
    return held.join(F.broadcast(codes), "code", "left").select("c_custkey", "style")
