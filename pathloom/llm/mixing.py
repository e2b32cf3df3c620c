"""Mix sources to target weights by entropy balancing.

Every document d of a source gets a rate r = min(cap, exp(theta * size / mean size)), the rates closest to 1 in relative
entropy, among those up to ``cap``, whose words meet the target of the source. ``theta`` is the dual variable of that
constraint. Newton iterations over the whole corpus find it for all sources at once; the corpus enters them as exact counts
per source and size, so an iteration reads a table of sizes. Rates are then rounded to copies without
randomness: sums are exact decimals, and ties go by hash and id, so reruns agree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.joins import left_join
from pathloom.scale import cut_lineage, number_rows

WORD = r"[^\x20\x09-\x0D]+"
# Documents of one source and size are dealt to groups of about this many before their copies are assigned.
GROUP_ROWS = 256
# As many sources are held beside the table of sizes in each task; more are joined by a shuffle.
FEW_SOURCES = 100_000
TOLERANCE = 1e-7
_EXACT = "decimal(38,9)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source of ``sizes (source, source_size)`` its target of words: ``share`` of all words by the weights, which
    repeat over the sources in code-point order (null last). No target is above ``cap`` times its source; what is cut off
    is shared by weight among the others until none is above."""
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight))
    most = F.col("source_size") * F.lit(float(cap))
    rate, capped = 0.0, -1
    while True:
        above = most <= F.col("weight") * rate
        row = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        total, fixed, open_weight, now = (x or 0 for x in row)
        if now == capped or not open_weight:
            break
        rate, capped = max(0.0, share * total - fixed) / open_weight, now
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(rate)) if open_weight else most)


def _rates(theta: Column, cap: float) -> Column:
    tilted = F.exp(F.least(theta * F.col("size") / F.col("mean_size"), F.lit(math.log(cap))))
    return F.least(tilted, F.lit(float(cap))).cast(_EXACT)


def balance(cells: DataFrame, targets: DataFrame, cap: float = 2.0, max_iterations: int = 80) -> DataFrame:
    """The dual variable ``theta`` of each source.

    :param cells: ``source_no, size, n``: documents per source and positive size.
    :param targets: ``source_no, source_size, target``.
    """
    bounds = cells.groupBy("source_no").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = targets.join(bounds, "source_no").select(
        "source_no", "target", (F.col("source_size") / F.col("docs")).alias("mean_size"),
        (F.col("source_size") / F.col("docs") / F.col("least")).alias("reach"),
        (F.col("target") / F.col("source_size")).alias("part"),
    )
    # Beyond low all rates together are below the target, beyond high every rate is at the cap.
    state = cut_lineage(state.select(
        "source_no", "target", "mean_size",
        F.when(F.col("part") < 1, F.log(F.greatest("part", F.lit(1e-12))) * F.col("reach")).otherwise(0.0).alias("low"),
        (F.lit(math.log(cap)) * F.col("reach")).alias("high"),
        F.when(F.col("part") >= cap * (1 - 1e-12), F.lit(math.log(cap)) * F.col("reach")).otherwise(0.0).alias("theta"),
    ))
    few = state.count() <= FEW_SOURCES
    for _ in range(max_iterations):
        rate = _rates(F.col("theta"), cap)
        words = F.col("n") * F.col("size")
        slope = F.when(rate < cap, words * (F.col("size") / F.col("mean_size")).cast(_EXACT).cast("double") * rate.cast("double"))
        sums = (
            cells.join(F.broadcast(state) if few else state, "source_no")
            .groupBy("source_no")
            .agg(F.sum((words * rate).cast("decimal(38,6)")).cast("double").alias("got"),
                 F.sum(F.coalesce(slope, F.lit(0.0)).cast("decimal(38,6)")).cast("double").alias("slope"))
        )
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("theta")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("theta")).otherwise(F.col("high"))
        step = F.col("theta") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        good = F.abs(off) <= F.col("target") * TOLERANCE
        state = cut_lineage(state.join(F.broadcast(sums) if few else sums, "source_no").select(
            "source_no", "target", "mean_size", low.alias("low"), high.alias("high"),
            F.when(good | (high <= low), F.col("theta")).when(inside, step).otherwise((low + high) / 2).alias("theta"),
            (good | (high <= low)).alias("good"),
        ))
        if not state.filter(~F.col("good")).limit(1).count():
            break
        state = state.drop("good")
    return state.select("source_no", "mean_size", "theta")


def _whole_copies(cap: float):
    """Rounds the rates of one source to copies per size. Longer documents come first, and each size makes up for the words
    that the rounding of the longer ones gave too many or too few."""
    def work(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("size", ascending=False)
        owed, copies = 0, []  # in words times 10**9, exact
        for size, n, rate in zip(table["size"].tolist(), table["n"].tolist(), table["rate"].tolist()):
            owed += n * size * rate
            unit = size * 10**9
            k = min(max((2 * owed + unit) // (2 * unit), 0), int(cap * n))
            owed -= k * unit
            copies.append(k)
        return table.assign(copies=copies)[["source_no", "size", "n", "copies"]]

    return work


def _plan(sized: DataFrame, weights, share: float, cap: float, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``source, size, place`` of all documents: the targets of the sources, the number of groups of each cell (source and
    size), and of each group the copies of all its documents and the last place that gets one more."""
    counts = cut_lineage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, cap))
    few = targets.count() <= FEW_SOURCES
    cells = cut_lineage(_named(counts, targets).filter("size > 0").select("source_no", "size", "n"))
    theta = balance(cells, targets.filter("source_size > 0"), cap)
    rate = (_rates(F.col("theta"), cap) * 10**9).cast("long")
    rated = cells.join(F.broadcast(theta) if few else theta, "source_no").select("source_no", "size", "n", rate.alias("rate"))
    # One row per source and size, so a source has no more of them than its longest document has words.
    whole = rated.groupBy("source_no").applyInPandas(_whole_copies(cap), "source_no long, size long, n long, copies long")
    rounded = cut_lineage(whole.select(
        _cell().alias("cell"), F.col("n").alias("cell_rows"), F.col("copies").alias("cell_copies"),
        F.ceil(F.col("n") / group_rows).alias("groups")))
    groups = rounded.select("cell", "groups")

    # Copies of a row share a place, so however many there are, a group stays small.
    places = _named(sized, targets).filter("size > 0").withColumn("cell", _cell()).groupBy("cell", "place").agg(F.count(F.lit(1)).alias("rows"))
    places = cut_lineage(_grouped(left_join(places, groups, "cell")).select("cell", "group", "place", "rows"))
    by_cell = Window.partitionBy("cell").orderBy("group_no")
    upto = F.expr("(sum(m) over (partition by cell order by group_no)) * cell_copies div cell_rows")
    of_group = left_join(places.groupBy("cell", "group").agg(F.sum("rows").alias("m")), rounded, "cell", 24)
    of_group = (
        of_group.withColumn("group_no", F.element_at(F.split("group", ":"), -1).cast("long")).withColumn("upto", upto)
        .withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(by_cell), F.lit(0)))
        .select("group", F.expr("k div m").alias("base"), (F.col("k") % F.col("m")).alias("extra"))
    )
    running = F.sum("rows").over(Window.partitionBy("group").orderBy("place"))
    last = places.withColumn("running", running).join(of_group, "group").groupBy("group", "base").agg(
        F.max(F.when(F.col("running") <= F.col("extra"), F.col("place"))).alias("last_place"))
    return targets, groups, cut_lineage(last)


def _cell() -> Column:
    return F.concat_ws(":", "source_no", "size")


def _named(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with the number, size and target of their source; null is a source."""
    named = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    named = F.broadcast(named) if named.count() <= FEW_SOURCES else named
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _grouped(rows: DataFrame) -> DataFrame:
    number = F.pmod(F.xxhash64("place", F.lit(7)), F.coalesce("groups", F.lit(1)))
    return rows.withColumn("group", F.concat_ws(":", "cell", number))


def _placed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": word_count(F.col("text")), "place": F.xxhash64("doc_id", "text")})


def _with_copies(placed: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    targets, groups, last = plan
    rows = _grouped(left_join(_named(placed, targets).withColumn("cell", _cell()), groups, "cell"))
    rows = left_join(rows, last, "group", 24)
    more = F.when(F.col("place") <= F.col("last_place"), 1).otherwise(0)
    return rows.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("base") + more).cast("long"))


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Copies of each document so that the words of each source meet its target.

    Reads ``doc_id, text, source``; other columns are ignored. One row per row of ``docs``: ``doc_id, size`` (words; 0
    without text), ``source_size, target`` (of its source), ``copies`` (0 to ``cap``, a whole number) and ``taken = copies * size``.
    A document without words keeps one copy. Rows that repeat get the same number of copies. An empty table gives an empty
    one. The words taken of a source miss its target by half of its shortest document or, where that is capped, little more.

    No group is large: copies are settled per source and size, then per dealt group of about ``group_rows`` documents,
    then by hash within it.
    """
    sized = cut_lineage(_placed(docs.select("doc_id", "text", "source")).drop("text"))
    mixed = _with_copies(sized, _plan(sized, weights, share, cap, group_rows))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` says, with all their columns."""
    kept = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    sized = cut_lineage(_placed(docs.select("doc_id", "text", "source")).drop("text"))
    arguments = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0, "group_rows": GROUP_ROWS} | options
    mixed = _with_copies(_placed(kept).drop("text"), _plan(sized, **arguments)).filter("copies > 0")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
