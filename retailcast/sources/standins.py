"""Stand-in inputs built from the driver tables.

The forecasting job expects five inputs (train, test, stores, oil,
holidays_events) and, for the search reports, a trial log.  These builders
only map rows of the TPC-H-like tables into those schemas; none of them does
any of the job's work.  The same mappings are written in SQL in
``retailcast.plans.oracle`` so DuckDB can rebuild identical inputs.

Fixed values of the mapping (chosen once, documented in FIXTURES.md):

* fact: date = to_date(l_shipdate), store_nbr = l_suppkey,
  family = l_returnflag, sales = sum(l_extendedprice * (1 - l_discount)),
  onpromotion = count of lines with l_discount >= 0.05
* test period starts 2001-07-01 (sales hidden)
* id = (unix_date(date) * 2^31 + store_nbr) * 128 + ascii(family)
* store type bands on s_acctbal: >= 7500 A, >= 5000 B, >= 2500 C, >= 0 D, else E
* oil = avg(o_totalprice) per order date, weekdays only, from 1995-01-10
* holidays from orders x customer x nation x region:
  (1-URGENT, F) Holiday; (1-URGENT, P) Transfer; (2-HIGH, F) Event;
  (3-MEDIUM, F) Bridge; everything else 'Work Day' (a type the job ignores);
  locale by c_mktsegment: AUTOMOBILE National; BUILDING, FURNITURE Regional;
  others Local.  National locale_name 'Ecuador', regional = region name,
  local = nation name.  Event descriptions by segment: MACHINERY
  'Terremoto Manabi', HOUSEHOLD 'Mundial de futbol Brasil', others
  'Dia de la Madre'; Bridge 'Puente ' || nation; others 'Fiesta ' || locale_name.
  transferred: null when c_acctbal < 0, else c_acctbal > 9000.
* trial log from events: one search per event_type; target = -value / 100;
  k = props.k; gamma = 1 + 9k/100; learning_rate = 1 / (1 + user_id);
  max_depth = 3 + 9k/100; n_estimators = 10k; subsample = value / (value + 1);
  elapsed = seconds since the search's first event; delta = value / 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.sources.tables import read_table

TEST_START = "2001-07-01"
OIL_START = "1995-01-10"


def row_id(date: Column, store_nbr: Column, family: Column) -> Column:
    """Unique row id of a (date, store, family) key computed per row (no global sort)."""
    return ((F.unix_date(date).cast("long") * F.lit(1 << 31) + store_nbr.cast("long"))
            * F.lit(128) + F.ascii(family).cast("long"))


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, store_nbr, family); partial aggregation before the shuffle."""
    li = read_table(spark, sf_dir, "lineitem", "l_shipdate", "l_suppkey", "l_returnflag",
                    "l_extendedprice", "l_discount")
    fact = (li.groupBy(F.to_date("l_shipdate").alias("date"),
                       F.col("l_suppkey").alias("store_nbr"),
                       F.col("l_returnflag").alias("family"))
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales"),
                 F.count(F.when(F.col("l_discount") >= 0.05, 1)).alias("onpromotion")))
    return fact.select(row_id(F.col("date"), F.col("store_nbr"), F.col("family")).alias("id"),
                       "date", "store_nbr", "family", "sales", "onpromotion")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test rows in one frame, from one scan: test rows have no sales and is_test true."""
    fact = sales_fact(spark, sf_dir)
    is_test = F.col("date") >= F.lit(TEST_START).cast("date")
    return (fact.withColumn("sales", F.when(~is_test, F.col("sales")))
            .withColumn("is_test", is_test))


def train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_fact(spark, sf_dir).filter(F.col("date") < F.lit(TEST_START).cast("date"))


def test_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sales_fact(spark, sf_dir).filter(F.col("date") >= F.lit(TEST_START).cast("date"))
            .drop("sales"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier x nation x region; nation and region are fixed 25- and 5-row dimensions."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    bal = F.col("s_acctbal")
    store_type = (F.when(bal >= 7500, "A").when(bal >= 5000, "B").when(bal >= 2500, "C")
                  .when(bal >= 0, "D").otherwise("E"))
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("s_suppkey").alias("store_nbr"), F.col("n_name").alias("city"),
                    F.col("r_name").alias("state"), store_type.alias("type"),
                    (F.col("s_suppkey") % 17).alias("cluster")))


def oil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per market day; weekends and early days are absent, as in a real quote feed."""
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    d = F.to_date("o_orderdate")
    return (o.filter((F.weekday(d) < 5) & (d >= F.lit(OIL_START).cast("date")))
            .groupBy(d.alias("date")).agg(F.avg("o_totalprice").alias("dcoilwtico")))


def holidays_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_custkey", "o_orderpriority",
                   "o_orderstatus")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment",
                   "c_acctbal")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    df = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left")
          .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left"))
    prio, status, seg = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("c_mktsegment")
    kind = (F.when((prio == "1-URGENT") & (status == "F"), "Holiday")
            .when((prio == "1-URGENT") & (status == "P"), "Transfer")
            .when((prio == "2-HIGH") & (status == "F"), "Event")
            .when((prio == "3-MEDIUM") & (status == "F"), "Bridge")
            .otherwise("Work Day"))
    locale = (F.when(seg == "AUTOMOBILE", "National")
              .when(seg.isin("BUILDING", "FURNITURE"), "Regional").otherwise("Local"))
    df = df.select(F.to_date("o_orderdate").alias("date"), kind.alias("type"),
                   locale.alias("locale"), seg, "n_name", "r_name", "c_acctbal")
    locale_name = (F.when(F.col("locale") == "National", "Ecuador")
                   .when(F.col("locale") == "Regional", F.col("r_name"))
                   .otherwise(F.col("n_name")))
    event_descr = (F.when(seg == "MACHINERY", "Terremoto Manabi")
                   .when(seg == "HOUSEHOLD", "Mundial de futbol Brasil")
                   .otherwise("Dia de la Madre"))
    descr = (F.when(F.col("type") == "Event", event_descr)
             .when(F.col("type") == "Bridge", F.concat(F.lit("Puente "), F.col("n_name")))
             .otherwise(F.concat(F.lit("Fiesta "), locale_name)))
    transferred = F.when(F.col("c_acctbal") < 0, F.lit(None).cast("boolean")).otherwise(
        F.col("c_acctbal") > 9000)
    return df.select("date", "type", "locale", locale_name.alias("locale_name"),
                     descr.alias("description"), transferred.alias("transferred"))


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the JSON trial-log schema plus a ``search`` and ``trial_id`` column."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type",
                    "value", "props")
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("double")
    ev = ev.select(F.col("event_type").alias("search"), F.col("event_id").alias("trial_id"),
                   "ts", secs.alias("secs"), k.alias("k"), "user_id", "value")
    # search start: a partial aggregate, then a size-checked broadcast of the
    # one-row-per-search table (no shuffle of the events, however hot a search is)
    from retailcast.operators.joins import join_dimension
    start = ev.groupBy("search").agg(F.min("secs").alias("start"))
    ev = join_dimension(ev, start, "search", "inner")
    params = F.struct(
        (1 + 9 * F.col("k") / 100).alias("gamma"),
        (1 / (1 + F.col("user_id").cast("double"))).alias("learning_rate"),
        (3 + 9 * F.col("k") / 100).alias("max_depth"),
        (10 * F.col("k")).alias("n_estimators"),
        (F.col("value") / (F.col("value") + 1)).alias("subsample"))
    when = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
                    (F.col("secs") - F.col("start")).alias("elapsed"),
                    (F.col("value") / 10).alias("delta"))
    return ev.select("search", "trial_id", (-F.col("value") / 100).alias("target"),
                     params.alias("params"), when.alias("datetime"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kNN input: (vec_id, features array<double>, label double)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("double").alias("label"))
