"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in an order shuffled by a seeded hash. A document's virtual finish time is the source's
words up to and including it, divided by the source's target. All documents are sorted by it, range by range, and the
mix is cut where its words reach the budget. A source whose target exceeds its size goes round again, up to
``MOST_REPEATS`` times.

Cases: null texts and texts without words have size 0 and are never taken; a null source is a source of its own, last
in order. Rows equal in doc_id, source and text are counted first and numbered again, in steps of ``COPIES`` that are
dealt out anew, so a group of any size is no single task's work and no long array. An empty table gives an empty result. Other columns are kept by ``mixture`` and ignored by
``shares``, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

WEIGHTS, BUDGET, MOST_REPEATS, SEED = (5, 2, 1), 1.5, 2, 99
RUN_ROWS, RUN_BITS, MOST_RUN_BITS = 1 << 17, 10, 20  # a source's order is cut into 2^RUN_BITS runs, or so many that a run has RUN_ROWS rows; each is summed on its own
COPIES = 1 << 12  # copies of a row that are numbered at a time
RANGES = 1 << 18  # ranges of virtual finish time


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, times: str, number: str, key: list[str], largest: int) -> DataFrame:
    """Each row as often as its long ``times`` says, with ``number`` from 1 on.

    ``largest``: the most copies of a row. Beyond ``COPIES`` they are made in steps, dealt out by ``key`` and step, so
    that no array is longer than that for up to ``COPIES`` ** 3 copies.
    """
    out = rows.filter(F.col(times) <= COPIES).withColumn(number, F.explode(F.expr(f"sequence(1L, `{times}`)")))
    if largest <= COPIES:
        return out
    wide = COPIES**2
    many = rows.filter(F.col(times) > COPIES).withColumn("_at", F.explode(F.expr(f"sequence(0L, `{times}` - 1, {wide}L)")))
    many = many.withColumn("_at", F.explode(F.expr(f"sequence(_at, least(`{times}`, _at + {wide}L) - 1, {COPIES}L)"))).repartition(F.xxhash64(*key, "_at"))
    return out.unionByName(many.withColumn(number, F.explode(F.expr(f"sequence(_at + 1, least(`{times}`, _at + {COPIES}L))"))).drop("_at"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size`` with ``target``: shares of the budget by weight, none above ``most`` times the size.

    Sources reach their limit in order of limit a weight; the first that doesn't gives the level of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(budget))
    up = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / rest)
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "level"))).over(Window.partitionBy(F.lit(0)))["level"])
    return s.select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("w")), "limit").alias("target"))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """``doc_id, h, size, source, source_size, target, taken``: words of each row that the mix takes, a row for each row.

    ``h`` is the row's seeded hash, which also gives its place in its source's order.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = written(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")), "sized")
    n_rows, largest = rows.agg(F.count("*"), F.max("m")).first()
    bits = min(MOST_RUN_BITS, max(RUN_BITS, (n_rows // RUN_ROWS).bit_length()))
    rows = rows.withColumn("run", F.shiftright("h", 64 - bits))
    runs = rows.groupBy("source", "run").agg(F.sum(F.col("size") * F.col("m")).alias("run_size"))
    runs = written(runs, "runs")
    goals = targets(runs.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, budget, most)
    runs = runs.withColumn("before", F.sum("run_size").over(Window.partitionBy("source").orderBy("run")) - F.col("run_size"))
    goals = goals.withColumnRenamed("source", "s")
    runs = runs.join(goals, runs.source.eqNullSafe(goals.s)).select(F.col("source").alias("s"), F.col("run").alias("r"), "before", "source_size", "target")
    placed = rows.join(runs, rows.source.eqNullSafe(runs.s) & (rows.run == runs.r))
    within = Window.partitionBy("source", "run").orderBy("h", "doc_id")
    start = F.col("before") + F.sum(F.col("size") * F.col("m")).over(within) - F.col("size") * F.col("m")
    placed = numbered(placed.withColumn("start", start), "m", "j", ["h", "doc_id"], largest or 0)
    one = written(placed.select("doc_id", "source", "size", "h", "j", "source_size", "target", (F.col("start") + F.col("j") * F.col("size")).alias("ends")), "order")

    def finish(again: int) -> Column:
        return F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("ends") + F.lit(again) * F.col("source_size")) / F.col("target"))

    # Global order: ranges of finish time are summed; only the range in which the budget is reached is sorted by itself.
    turns = F.explode(F.array(*[F.struct(finish(e).alias("v"), F.lit(e).alias("e")) for e in range(most)])).alias("t")
    items = one.select("size", "h", "doc_id", "source", "j", turns).select("*", "t.v", "t.e").filter("v is not null")
    items = items.withColumn("range", F.least(F.floor(F.col("v") * (RANGES // 2)), F.lit(RANGES)).cast("long"))
    total = one.agg(F.sum("size")).first()[0] or 0
    words = int(total * budget)
    sums = items.groupBy("range").agg(F.sum("size").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy("range")))  # as many rows as ranges at most
    cut = upto.filter(F.col("upto") > words).agg(F.min(F.struct("range", "upto", "n")).alias("c")).first()["c"]
    if cut is None:
        took = [F.lit(1)] * most
    else:
        place = F.struct("v", "h", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("i"), F.coalesce("source", F.lit("￿")).alias("s"), "j", "e")
        last = items.filter(F.col("range") == cut["range"]).withColumn("place", place)
        last = last.withColumn("upto", F.sum("size").over(Window.orderBy("place")) + F.lit(cut["upto"] - cut["n"]))
        end = last.filter(F.col("upto") <= words).agg(F.max("place").alias("p")).first()["p"]
        took = []
        for e in range(most):
            v = finish(e)
            r = F.least(F.floor(v * (RANGES // 2)), F.lit(RANGES)).cast("long")
            early = r < cut["range"]
            if end is not None:
                mine = F.struct(v.alias("v"), F.col("h"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("i"), F.coalesce("source", F.lit("￿")).alias("s"), F.col("j"), F.lit(e).alias("e"))
                bound = F.struct(F.lit(end["v"]), F.lit(end["h"]).cast("long"), F.lit(end["i"]).cast("long"), F.lit(end["s"]), F.lit(end["j"]).cast("long"), F.lit(end["e"]))
                early = early | ((r == cut["range"]) & (mine <= bound))
            took.append(F.when(early, 1).otherwise(0))
    return one.select("doc_id", "h", "size", "source", "source_size", "target", (F.col("size") * sum(took[1:], took[0])).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix's documents with the columns of ``docs``, a row for each time a document is taken."""
    times = F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)).cast("long")
    plan = written(shares(docs, weights, budget, most, seed).groupBy("doc_id", "h", "source").agg(times.alias("_times"), F.count("*").alias("_rows")).filter("_times > 0"), "plan")
    plan = plan.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("source").alias("s"), "_times", "_rows")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    keyed = docs.select(F.struct(*docs.columns).alias("record"), doc_id.alias("own_i"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("own_g"), source.alias("own_s"))
    same = F.col("own_i").eqNullSafe(F.col("i")) & (F.col("own_g") == F.col("g")) & F.col("own_s").eqNullSafe(F.col("s"))
    out = keyed.join(plan.filter("_rows = 1"), same).select("record", F.explode(F.expr("sequence(1L, _times)")))
    largest = plan.filter("_rows > 1").agg(F.max("_times")).first()[0]
    if largest:  # rows equal in doc_id, source and text: one of them is taken for all
        one = keyed.join(plan.filter("_rows > 1"), same).groupBy("i", "g", "s", "_times").agg(F.first("record").alias("record"))
        out = out.unionByName(numbered(one, "_times", "col", ["i", "g"], largest).select("record", "col"))
    return out.select(*[F.col("record")[c].alias(c) for c in docs.columns])
