"""Queries on evaluation: precision and recall, matching, calibration, cut-offs, percentiles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..evaluate import matching, metrics
from ..tables import table
from .registry import query

SIGNS = r"[#$%&*]{3}|!!| \| "
GUESSED = "select l.doc_id, l.quality, l.toxic, d.source, d.n_chars, not regexp_matches(d.text, '[#$%&*]{3}|!!| \\| ') as good from labels l join documents d on d.doc_id = l.doc_id"


def _guessed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", (~F.col("text").rlike(SIGNS)).alias("good"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")


@query(f"select quality as gold, good as predicted, count(*) as n from ({GUESSED}) group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_guessed(spark, sf_dir).withColumnsRenamed({"quality": "gold", "good": "predicted"}), "gold", "predicted")


BUCKETED = f"select 'quality' as field, 'good=' || cast(good as int) || '|long=' || cast(n_chars > 1000 as int) as bucket, quality = 1 as correct, doc_id from ({GUESSED})"


def _bucketed(spark, sf_dir):
    g = _guessed(spark, sf_dir)
    b = F.concat(F.lit("good="), F.col("good").cast("int").cast("string"), F.lit("|long="), (F.col("n_chars") > 1000).cast("int").cast("string"))
    return g.select("doc_id", F.lit("quality").alias("field"), b.alias("bucket"), (F.col("quality") == 1).alias("correct"))


@query(f"select field, bucket, count(*) as n, round((count(*) filter (where correct) + 1)::double / (count(*) + 2), 9) as acc from ({BUCKETED}) where doc_id % 2 = 0 group by all")
def calibration_buckets(spark, sf_dir):
    t = metrics.calibration_table(_bucketed(spark, sf_dir).filter("doc_id % 2 = 0"))
    return t.withColumn("acc", F.round("acc", 9))


@query(f"""with o as ({BUCKETED}), t as (select bucket, (count(*) filter (where correct) + 1)::double / (count(*) + 2) as acc from o where doc_id % 2 = 0 group by bucket),
b as (select o.bucket, count(*) as n, avg(coalesce(acc, 0.5)) as conf, avg(correct::int::double) as hit from o left join t on t.bucket = o.bucket where doc_id % 2 = 1 group by o.bucket)
select 'quality' as field, cast(sum(n) as bigint) as n, round(sum(n * conf) / sum(n), 9) as mean_confidence, round(sum(n * hit) / sum(n), 9) as accuracy, round(sum(n * abs(conf - hit)) / sum(n), 9) as ece from b""")
def calibration_ece(spark, sf_dir):
    b = _bucketed(spark, sf_dir)
    out = metrics.calibration_error(b.filter("doc_id % 2 = 1"), metrics.calibration_table(b.filter("doc_id % 2 = 0")))
    return out.select("field", "n", *[F.round(c, 9).alias(c) for c in ("mean_confidence", "accuracy", "ece")])


PER_SOURCE = f"""select source, doc_id % 4 as part, count(*) filter (where good) as p, count(*) filter (where quality = 1) as g, count(*) filter (where good and quality = 1) as c from ({GUESSED}) group by all"""
RATES = f"select source, p, g, c, case when p > 0 then c::double / p else 1.0 end as pr, case when g > 0 then c::double / g else 1.0 end as re from ({PER_SOURCE})"


@query(f"""with r as ({RATES}), f as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end as f from r),
m as (select source, avg(pr) as a, avg(re) as b, avg(f) as c, case when sum(p) > 0 then sum(c)::double / sum(p) else 1.0 end as d, case when sum(g) > 0 then sum(f.c)::double / sum(g) else 1.0 end as e from f group by source)
select source, round(a, 9) as macro_precision, round(b, 9) as macro_recall, round(c, 9) as macro_f1, round(d, 9) as micro_precision, round(e, 9) as micro_recall, round(case when d + e > 0 then 2 * d * e / (d + e) else 0.0 end, 9) as micro_f1 from m""")
def macro_micro(spark, sf_dir):
    g = _guessed(spark, sf_dir)
    per = g.groupBy("source", (F.col("doc_id") % 4).alias("part")).agg(F.count_if("good").alias("n_predicted"), F.count_if(F.col("quality") == 1).alias("n_gold"), F.count_if(F.col("good") & (F.col("quality") == 1)).alias("n_correct"))
    p, r = metrics.rate(F.col("n_correct"), F.col("n_predicted")), metrics.rate(F.col("n_correct"), F.col("n_gold"))
    out = metrics.macro_micro(per.withColumns({"precision": p, "recall": r, "f1": metrics.f1(p, r)}), "source")
    return out.select("source", *[F.round(c, 9).alias(c) for c in out.columns if c != "source"])


@query("""select event_type, count(*) as n, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95 from events group by event_type""")
def percentile_latency(spark, sf_dir):
    out = metrics.percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")
    return out.withColumns({c: F.round(c, 9) for c in ("p50", "p95")})


CUTS = [-0.5, 0.0, 0.5, 1.0]


@query("""with s as (select label % 3 as k, embedding[1]::double as score, label % 2 = 0 as correct from embeddings), g as (select * from s cross join (values (-0.5::double), (0.0::double), (0.5::double), (1.0::double)) c(cutoff)),
t as (select k, cutoff, count(*) filter (where score >= cutoff and correct) as tp, count(*) filter (where score >= cutoff and not correct) as fp, count(*) filter (where score < cutoff and correct) as fn from g group by all),
r as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 1.0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 1.0 end as q from t)
select k, cutoff, tp, fp, fn, round(p, 9) as "precision", round(q, 9) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0.0 end, 9) as f1 from r""")
def cutoff_grid(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("k"), F.col("embedding")[0].cast("double").alias("score"), (F.col("label") % 2 == 0).alias("correct"))
    out = metrics.at_cutoffs(s, spark.createDataFrame([(c,) for c in CUTS], "cutoff double"), "k")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""with w as (select doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(text)), '[.,;:!?''"()\\[\\]‘’“”«»„]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) as ws from documents),
j as (select a.doc_id, a.ws as p, b.ws as g, len(list_intersect(a.ws, b.ws)) as n from w a join w b on b.doc_id = a.doc_id + 1),
r as (select doc_id, case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) > 0 then n::double / len(p) else 0.0 end as pr, case when len(p) = 0 and len(g) = 0 then 1.0 when len(g) > 0 then n::double / len(g) else 0.0 end as re from j)
select doc_id, round(pr, 9) as "precision", round(re, 9) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 9) as f1 from r""")
def neighbour_set_prf(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", metrics.tokens(F.array("text"), compat=False).alias("p"))
    both = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("g")), "doc_id").withColumn("x", metrics.set_prf(F.col("p"), F.col("g")))
    return both.select("doc_id", *[F.round(F.col("x")[c], 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""select c_custkey, field, applicable, case when applicable then correct end as correct from (
 select c_custkey, 'name' as field, c_custkey % 5 <> 0 as applicable, c_custkey % 7 <> 0 as correct from customer union all select c_custkey, 'phone', true, c_custkey % 3 <> 0 from customer)""")
def scalar_scoring(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    number = F.lpad((k + 9_000_000_000).cast("string"), 10, "0")
    gold = c.select("c_custkey", F.when(k % 5 != 0, F.col("c_name")).otherwise("").alias("name"), F.concat(F.lit("+91 "), number).alias("phone"))
    predicted = c.select("c_custkey", F.when(k % 7 != 0, F.concat(F.upper("c_name"), F.lit("."))).otherwise(F.concat("c_name", F.lit(" x"))).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("0"), number)).otherwise(F.concat(F.lit("1"), F.substring(number, 1, 9))).alias("phone"))
    return metrics.scalar_scores(predicted, gold, {"name": "exact", "phone": "phone"}, "c_custkey", compat=False)


@query("""select a.n_nationkey as k, round(levenshtein(a.n_name, b.n_name)::double / greatest(length(b.n_name), 1), 9) as cer from nation a join nation b on b.n_nationkey = a.n_nationkey + 1""")
def character_errors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("read"))
    pairs = n.join(n.select((F.col("k") - 1).alias("k"), F.col("read").alias("truth")), "k")
    return metrics.character_errors(pairs).select("k", F.round("cer", 9).alias("cer"))


@query("""with c as (select o_custkey, o_orderkey % 26 as letter, count(*) filter (where o_orderkey % 5 <> 0) as p, count(*) filter (where o_orderkey % 7 <> 0) as g from orders group by 1, 2),
s as (select o_custkey, cast(sum(p) as bigint) as n_predicted, cast(sum(g) as bigint) as n_gold, cast(sum(least(p, g)) as bigint) as n_matched, cast(sum(case when (letter + o_custkey) % 3 = 0 then 0 else least(p, g) end) as bigint) as n_correct from c group by 1 having sum(p) + sum(g) > 0)
select *, round(case when n_predicted + n_gold > 0 then 2.0 * n_correct / (n_predicted + n_gold) else 1.0 end, 9) as f1 from s where n_predicted > 0 and n_gold > 0""")
def entity_match_prf(spark, sf_dir):
    """Orders of each customer as entries, keyed by one of 26 letters, some predicted, some spoilt by half: the best
    one-to-one matching pairs equal letters, and spoilt ones are matched but wrong."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("int").alias("ord"))
    letter = F.char(F.lit(97) + F.col("ord") % 26)
    gold = o.filter("ord % 7 <> 0").withColumn("key", F.repeat(letter, F.lit(10)))
    spoilt = (F.col("ord") % 26 + F.col("o_custkey")) % 3 == 0
    predicted = o.filter("ord % 5 <> 0").withColumn("key", F.when(spoilt, F.concat(F.repeat(letter, F.lit(5)), F.lit("00000"))).otherwise(F.upper(F.repeat(letter, F.lit(10)))))
    scores = metrics.entity_scores(predicted, gold, matching.match_entries(predicted, gold, "o_custkey"), "o_custkey")
    return scores.filter("n_predicted > 0 and n_gold > 0").select("o_custkey", "n_predicted", "n_gold", "n_matched", "n_correct", F.round("f1", 9).alias("f1"))


@query("""select doc_id, sha256('{' || concat_ws(',', '"doc_id":' || doc_id, '"lang":"' || lang || '"', '"n_chars":' || n_chars, '"source":"' || source || '"') || '}') as digest from documents""")
def digests(spark, sf_dir):
    return metrics.digest(table(spark, sf_dir, "documents").select("source", "n_chars", "lang", "doc_id"))


@query("""select l_suppkey, l_orderkey, l_linenumber, row_number() over w as rn, sum(l_quantity) over (w rows unbounded preceding) as upto from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate)""")
def running_windows(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    so_far = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rn"), so_far.alias("upto"))
