"""Queries of relational kinds: joins, windows, intervals, boxes, sets, streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..evaluate.metrics import worst
from ..functions.similarity import winkler_pairs
from ..operators.header import lines_under
from ..operators.layout import interval_gaps, interval_islands, weighted_mode
from ..scratch import new_path
from ..streaming.records import windowed_counts
from ..tables import table
from .registry import query


@query("select d.doc_id, d.source from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null")
def anti_join_used(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left_anti")


@query("select source, count(*) as n from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) group by source")
def semi_exists(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("""select user_id, event_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)), 0) as gap_us from events""")
def sessions_gap_above(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", "ts", F.coalesce(micros - F.lag(micros).over(order), F.lit(0).cast("long")).alias("gap_us"))


@query("""with w as (select p_brand, round_even(p_size * 2.0 / 2, 0) as v, sum(length(p_type)) as w, min(p_partkey) as s from part group by 1, 2)
select p_brand, arg_max(v, (w, -s)) as mode, (select median(p_size) from part q where q.p_brand = w.p_brand) as middle from w group by p_brand""")
def body_mode(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mode = weighted_mode(p, F.bround(F.col("p_size") * 2.0 / 2, 0), F.length("p_type"), F.col("p_partkey"), "p_brand")
    return mode.join(p.groupBy("p_brand").agg(F.median("p_size").alias("middle")), "p_brand")


SHIPPED = "select l_suppkey, date_diff('day', date '1990-01-01', l_shipdate::date) as a, date_diff('day', date '1990-01-01', l_shipdate::date) + cast(l_quantity as int) % 5 as b from lineitem"
ISLANDS = f"""with s as ({SHIPPED}), g as (select *, case when a <= max(b) over (partition by l_suppkey order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from s),
i as (select *, sum(new) over (partition by l_suppkey order by a, b rows unbounded preceding) as isl from g), u as (select l_suppkey, min(a) as a, max(b) as b, count(*) as n from i group by l_suppkey, isl)"""


def _shipped(spark, sf_dir):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("a"), (day + F.rint("l_quantity").cast("int") % 5).alias("b"))


@query(ISLANDS + " select l_suppkey, a, b, n from u")
def interval_merge(spark, sf_dir):
    return interval_islands(_shipped(spark, sf_dir), "a", "b", "l_suppkey")


@query(ISLANDS + ", x as (select l_suppkey, b as gap_start, lead(a) over (partition by l_suppkey order by a) as gap_end from u) select * from x where gap_end - gap_start >= 3")
def interval_free(spark, sf_dir):
    return interval_gaps(_shipped(spark, sf_dir), "a", "b", 3, "l_suppkey")


BOXED = "select l_orderkey as k, l_linenumber as n, l_quantity * 10.0 as x0, l_linenumber * 12.0 as y0, l_quantity * 10.0 + 80 as x1, l_linenumber * 12.0 + 14 as y1 from lineitem"


@query(f"""with b as ({BOXED}), l as (select k, n, x0 + 20 as x0, y0 + 4 as y0, x0 + 60 as x1, y0 + 18 as y1 from b where n % 2 = 0),
h as (select l.k, l.n as link_ord, b.n as line_no, (least(l.x1, b.x1) - greatest(l.x0, b.x0)) as ox, (least(l.y1, b.y1) - greatest(l.y0, b.y0)) as oy from l join b on b.k = l.k)
select l.k as doc_id, l.n as link_ord, x.line_no from l left join (select k, link_ord, arg_max(line_no, (ox * oy, -line_no)) as line_no from h where ox > 0 and oy > 0 group by all) x on x.k = l.k and x.link_ord = l.n""")
def spatial_overlap_join(spark, sf_dir):
    """Boxes of order lines, and links drawn over every second one: the line that each link covers most."""
    x0, y0 = F.col("l_quantity") * 10.0, F.col("l_linenumber") * 12.0
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 80).alias("x1"), (y0 + 14).alias("y1"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("line_no"), box.alias("bbox"))
    over = F.struct((F.col("bbox.x0") + 20).alias("x0"), (F.col("bbox.y0") + 4).alias("y0"), (F.col("bbox.x0") + 60).alias("x1"), (F.col("bbox.y0") + 18).alias("y1"))
    links = lines.filter("line_no % 2 = 0").select("doc_id", "page_no", F.col("line_no").alias("link_ord"), over.alias("bbox"))
    return lines_under(links, lines).select("doc_id", "link_ord", "line_no")


@query("""with n as (select distinct p_name as name from part) select a.name as a, b.name as b, round(jaro_winkler_similarity(a.name, b.name), 6) as sim from n a join n b on a.name < b.name
where jaro_winkler_similarity(a.name, b.name) >= 0.85""")
def near_duplicate_parts(spark, sf_dir):
    return winkler_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("a")), 0.85).select("a", "b", F.round("similarity", 6).alias("sim"))


@query("""select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as qty, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def line_totals(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("qty"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""select n_name, r_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join orders on o_custkey = c_custkey group by 1, 2""")
def chained_joins(spark, sf_dir):
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    all_ = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(o, o.o_custkey == c.c_custkey, "left")
    return all_.groupBy("n_name", "r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("""select doc_id as k from documents where lang = 'en' intersect select doc_id from labels union all (select item_id from benchmark except select conv_id from conversations)""")
def set_operations(spark, sf_dir):
    d, l, b, c = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark", "conversations"))
    both = d.filter("lang = 'en'").select(F.col("doc_id").alias("k")).intersect(l.select("doc_id"))
    return both.union(b.select("item_id").subtract(c.select("conv_id")))


@query("""select source, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'fr') as fr, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'es') as es from documents group by source""")
def pivot_languages(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count()
    return out.na.fill(0)


@query("select source, doc_id, n_chars from documents order by n_chars, doc_id limit 10")
def topk_worst(spark, sf_dir):
    return worst(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "n_chars", "doc_id")


@query("""select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def windowed_events(spark, sf_dir):
    out = windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", "event_type")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select event_type, count(*) as n from events where value > 50 group by event_type""")
def stream_equals_batch(spark, sf_dir):
    """Events read as a stream, all that is there, and kept in a table; counted from that table."""
    folder = new_path(spark, "stream")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = source.filter("value > 50").select("event_id", "event_type")
    kept.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{folder}/table").groupBy("event_type").agg(F.count("*").alias("n"))


