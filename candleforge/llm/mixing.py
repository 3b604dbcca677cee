"""Mixing sources to token targets by entropy balancing.

Each source s has a token target T_s. Documents get rates r = min(2, exp(lambda_s * z)), where z = n / (n + mean) tilts
by a document's size n: of all rates up to 2 whose words, sum(n * r), meet the target, those least far from one copy
each in relative entropy, documents weighing n + mean, so that long ones move more than short ones. lambda_s is the
root of the convex dual's gradient, sum(n * r) - T_s, found for all sources at once by Newton steps whose gradient and
curvature are distributed aggregates over the sizes of each source, guarded by a bracket. Rates become whole copies
by a threshold on a hash of the id: the threshold of a source is refined until the copies' words meet its target, to
within about one document. Sums are exact (integers and decimals), so reruns agree bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.llm.common import checkpointed

# Fixed values of the mix: weights repeat over the sources in code-point order, null last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0

#: Sources that are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
_ONE = 1 << 20  # fixed-point unit of rates
_FINE = 1 << 32  # and of thresholds
_BINS = 256
_STEPS = 40


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _size_columns(id_col: str, text_col: str, source_col: str) -> list[Column]:
    key = F.col(id_col).cast("long")
    lot = F.shiftrightunsigned(F.xxhash64(key, F.lit("lot")), 32)
    return [key.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), lot.alias("lot")]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, lot): lot is a fixed pseudo-random number of the id, 0 to 2^32."""
    return docs.select(*_size_columns(id_col, text_col, source_col))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sid, source, source_size, n_docs, target) of every source of sizes (source, size).

    All targets add up to share * all sizes, split by weight; a target stops at most * its source's size and the
    excess goes to the others by weight, until none is above. The result has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    now = per.withColumn("sid", rank.cast("long")).withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    now = checkpointed(now.withColumn("capped", F.lit(False)))
    while True:
        cap = F.col("source_size") * F.lit(most)
        facts = now.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("capped"), cap)).alias("fixed"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w")
        ).first()
        unit = max(0.0, (facts["all"] or 0) * share - (facts["fixed"] or 0.0)) / facts["w"] if facts["w"] else 0.0
        above = ~F.col("capped") & (F.col("weight") * F.lit(unit) > cap)
        after = checkpointed(now.withColumn("_above", above).withColumn("capped", F.col("capped") | F.col("_above")))
        if not after.agg(F.max("_above").alias("m")).first().m:
            break
        now = after.drop("_above")
    target = F.when(F.col("capped"), F.col("source_size") * F.lit(most)).otherwise(F.col("weight") * F.lit(unit))
    return now.select("sid", "source", "source_size", "n_docs", target.cast("double").alias("target"))


def _rate(lam: Column, z: Column, most: float) -> Column:
    """Fixed-point min(most, exp(lam * z))."""
    return F.round(F.least(F.lit(most), F.exp(F.least(lam * z, F.lit(50.0)))) * _ONE).cast("long")


def _tilt() -> Column:
    """z of a row with size, source_size and n_docs."""
    return F.col("size") / (F.col("size") + F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)))


def _rated(rows: DataFrame, most: float) -> DataFrame:
    """Adds r, the fixed-point rate; whole, its whole part; at, the threshold above which a row gets one copy more."""
    rate = F.when(F.col("full"), F.lit(int(most * _ONE)).cast("long")).otherwise(_rate(F.col("lam"), _tilt(), most))
    fraction = (F.col("r") % _ONE) * (_FINE // _ONE)
    at = F.when(F.col("r") % _ONE > 0, F.col("lot") - fraction + _FINE)
    return rows.withColumn("r", rate).withColumns({"whole": F.floor(F.col("r") / _ONE).cast("long"), "at": at})


def _with(docs: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    return docs.join(F.broadcast(state) if small else state, "sid")


def _total(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)"))


def solved(sizes: DataFrame, most: float = MOST) -> tuple[DataFrame, bool]:
    """(plan, whether it is small) for sizes (source, size, lot): per source its target, the dual's solution `lam`, whether
    all rates are full, and the threshold `low` below which a row's `at` gives it one copy more."""
    sources = checkpointed(targets(sizes, most=most))
    small = sources.count() <= BROADCAST_SOURCES
    names = sources.select("sid", F.col("source").alias("_s"), "source_size", "n_docs")
    base = sizes.join(F.broadcast(names) if small else names, F.col("source").eqNullSafe(F.col("_s")))
    base = checkpointed(base.select("sid", "size", "lot"))
    # rates depend on a document's size and source only, so Newton steps add up sizes, not documents
    sizes_of = checkpointed(base.groupBy("sid", "size").agg(F.count("*").alias("n")))

    # the dual, one dimension per source; a target at the cap is met by full rates
    full = F.col("target") >= F.col("source_size") * F.lit(most)
    state = sources.select("sid", "source", "source_size", "n_docs", "target", F.lit(-64.0).alias("lo"), F.lit(256.0).alias("hi"), F.lit(0.0).alias("lam"), full.alias("full"))
    state = checkpointed(state)
    for _ in range(_STEPS):
        r = _rate(F.col("lam"), _tilt(), most)
        open_ = F.when(r < int(most * _ONE), F.round(_tilt() * r)).otherwise(0).cast("long")
        words = (F.col("size") * F.col("n")).cast("decimal(20,0)")
        rows = _with(sizes_of, state.select("sid", "source_size", "n_docs", "lam", "full"), small).where(~F.col("full"))
        sums = rows.groupBy("sid").agg(_total(words * r).alias("g"), _total(words * open_).alias("h"))
        got, slope = F.col("g").cast("double") / _ONE, F.col("h").cast("double") / _ONE
        joined = state.join(sums, "sid", "left").withColumns({"gap": got - F.col("target")})
        lo, hi = F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")), F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.col("gap") / F.when(slope > 0, slope)
        inside = F.coalesce((newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        done = F.coalesce(F.abs("gap") <= F.col("target") * 1e-5, F.lit(True))
        moved = joined.withColumns({"lo": lo, "hi": hi}).withColumn("lam", F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = checkpointed(moved.select("sid", "source", "source_size", "n_docs", "target", "lo", "hi", "lam", "full", done.alias("done")))
        if not state.where(~F.col("done") & ~F.col("full")).limit(1).count():
            break

    # copies: the whole part of the rate, and one more where the lot falls below the fraction, shifted per source
    rated = _rated(_with(base, state.select("sid", "source_size", "n_docs", "target", "lam", "full"), small), most)
    rated = checkpointed(rated.select("sid", "size", "target", "whole", "at"))
    need = rated.groupBy("sid").agg((F.first("target") - _total(F.col("size") * F.col("whole")).cast("double")).alias("need"))
    edge = checkpointed(need.withColumn("low", F.lit(0).cast("long")))
    width = 2 * _FINE
    while width > 1:
        width = max(1, width // _BINS)
        near = _with(rated.where(F.col("at").isNotNull() & (F.col("size") > 0)).select("sid", "size", "at"), edge.select("sid", "low"), small)
        step = F.floor((F.col("at") - F.col("low")) / width).cast("long")
        bins = near.withColumn("bin", step).where((F.col("bin") >= 0) & (F.col("bin") < _BINS)).groupBy("sid", "bin").agg(F.sum("size").alias("words"))
        running = checkpointed(_with(bins.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("bin"))), edge, small))
        fits = running.where(F.col("upto") <= F.col("need")).groupBy("sid").agg(F.max("upto").alias("used"))
        over = running.where(F.col("upto") > F.col("need")).groupBy("sid").agg(F.min("bin").alias("next"))
        # the threshold lies in the first bin that no longer fits, or beyond all
        moved = edge.join(fits, "sid", "left").join(over, "sid", "left")
        go = F.coalesce(F.col("next"), F.lit(_BINS))
        edge = checkpointed(moved.select("sid", (F.col("need") - F.coalesce("used", F.lit(0))).alias("need"), (F.col("low") + go * width).alias("low")))
    return checkpointed(state.join(edge.select("sid", "low"), "sid").select("source", "source_size", "n_docs", "target", "lam", "full", "low")), small


def _copied(rows: DataFrame, plan: DataFrame, small: bool, most: float) -> DataFrame:
    """rows (source, size, lot, ...) with their source's facts, r and copies."""
    facts = plan.withColumnRenamed("source", "_s")
    joined = rows.join(F.broadcast(facts) if small else facts, F.col("source").eqNullSafe(F.col("_s")))
    more = F.when(F.col("at") < F.col("low"), 1).otherwise(0)
    return _rated(joined, most).withColumn("copies", (F.col("whole") + more).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate double, copies int, taken long) of every row of docs.

    taken = copies * size, never above most * size. Null text has size 0; a null source is a source of its own,
    the last; null ids share one lot; repeated rows take part each, with equal lots; documents of size 0 change no
    sum and get a copy for a rate of 1. Long texts count whole; documents of one lot that the threshold would part are
    taken or left together. An empty table gives an empty result; other columns are not read.
    """
    sizes = checkpointed(sized(docs, id_col, text_col, source_col))
    out = _copied(sizes, *solved(sizes, most), most)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("r") / _ONE).alias("rate"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, all columns kept, whatever their names.

    Rows are not shuffled. Nulls, empty and long texts, ties and repeated rows are handled as by mix(); an empty table
    gives an empty result.
    """
    plan, small = solved(checkpointed(sized(docs, id_col, text_col, source_col)), most)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_size_columns(id_col, text_col, source_col))
    out = _copied(own, plan, small, most).where(F.col("copies") > 0)
    return out.select(F.explode(F.array_repeat(F.lit(0), F.col("copies"))), "_row").select("_row.*")
