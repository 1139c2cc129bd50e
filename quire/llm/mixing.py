"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words from its weight, at most ``max_repeats``
times its own; what a small source cannot use goes to the others by weight.
A document is then wanted a number of times (target by source size, times its
importance): the whole part are certain copies, the fraction is the odds of
one copy more. Documents are ranked by their random odds divided by these
inclusion odds, and the first ones are taken until the sample has its size:
the words that the certain copies left open. Longer documents are drawn first,
in levels by length, and the next level makes up for what one missed, so one
long text at the edge does not decide a source's total.

No source is sorted as a whole: ranks are cut into blocks by value, block
totals tell in which block the sample ends, and only that block is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
LEVELS = (1 / 16, 1 / 256)  # parts of its source's target above which a document is longer
ROWS_PER_BLOCK = 4096     # ranked rows in a block, about


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: str, *parts: Column) -> Column:
    """A number between 0 and 1 (52 bits, neither end) that depends on the
    seed and the values alone, so reruns and retries agree. Null is a value
    of its own."""
    joined = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("\x00"))
                                                for p in parts])
    head = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds divided by inclusion odds, ``q``, as ``q / (1 + q)``: a
    value from 0 to 1 of the same order. Inclusion 1 comes first, 0 last."""
    return (u * (1 - inclusion)) / (u * (1 - inclusion) + inclusion * (1 - u))


# --- targets --------------------------------------------------------------
def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` (words) to ``source, source_size``, a row per source,
    and ``at``, the source's place in the order of code points, null last.

    ``weights`` repeat along that order. Targets add up to all words: shares
    above ``max_repeats`` times a source are cut and shared out again by
    weight among the others until none is above.
    """
    ordered = materialize(totals.orderBy(F.col("source").isNull(), "source")
                          .withColumn("_row", F.monotonically_increasing_id()), "sources")
    # Rows before each partition of the sorted table: one row per partition.
    parts = ordered.groupBy(F.shiftright("_row", 33).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    before = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = (F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    placed = ordered.withColumn("_p", F.shiftright("_row", 33)).join(before, "_p") \
        .select("source", "source_size", at.alias("at")).withColumn("weight", weight)
    placed = materialize(placed, "sources")
    most = F.col("source_size") * max_repeats
    everything = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("w")).first()
    total = int(everything["size"] or 0)
    # Words per unit of weight. It grows with every round that cuts a source.
    level = total / everything["w"] if everything["w"] else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > most
        now = placed.agg(F.sum(F.when(above, most)).alias("cut"),
                         F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not now["free"] or (new := (total - int(now["cut"] or 0)) / now["free"]) <= level:
            break
        level = new
    share = F.col("weight") * F.lit(level)
    return placed.select("source", "source_size", "at", F.least(share, most.cast("double"))
                         .alias("target"))


# --- the sample -----------------------------------------------------------
def cut_points(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """Where the sample of each group (a level of a source) ends: ``at, block,
    rank, size, take, n, got``.

    ``rows`` has ``at`` (group), ``rank`` (0 to 1), ``size``, ``n_blocks``;
    ``aims`` has ``at`` and ``aim``, the words wanted. The sample is every row
    of an earlier block or of smaller ``(rank, size)`` and ``take`` of the
    ``n`` rows of just this pair; ``got`` words, as near to the aim as whole
    documents in rank order come.
    """
    blocks = rows.withColumn("block", _block()).groupBy("at", "block").agg(
        F.sum("size").alias("words"))
    running = Window.partitionBy("at").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = blocks.withColumn("upto", F.sum("words").over(running)).join(aims, "at") \
        .withColumn("before", F.col("upto") - F.col("words"))
    # The block in which the aim is reached, or the last one.
    ends = summed.groupBy("at").agg(
        F.min_by(F.struct("block", "before", "aim"), F.struct(
            F.col("upto") < F.col("aim"),
            F.when(F.col("upto") < F.col("aim"), -F.col("block")).otherwise(F.col("block"))))
        .alias("end")).select("at", "end.*")
    ends = materialize(ends, "ends")
    inside = rows.withColumn("block", _block()).join(ends, ["at", "block"])
    # Rows of one pair are copies of one document: they count as one step.
    steps = inside.groupBy("at", "block", "rank", "size", "before", "aim").agg(
        F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("at").orderBy("rank", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = F.col("n") * F.col("size")
    stepped = steps.withColumn("before", F.col("before") + F.sum(here).over(upto) - here)
    reached = F.col("before") + here >= F.col("aim")
    wanted = F.round((F.col("aim") - F.col("before")) / F.greatest(F.col("size"), F.lit(1)))
    take = F.greatest(F.lit(0), F.least(F.col("n"), wanted)).cast("long")
    return stepped.withColumn("take", take).groupBy("at").agg(
        F.min_by(F.struct("block", "rank", "size", "take", "n",
                          (F.col("before") + F.col("take") * F.col("size")).alias("got")),
                 F.struct(~reached, F.when(reached, F.col("rank")).otherwise(-F.col("rank")),
                          F.when(reached, F.col("size")).otherwise(-F.col("size"))))
        .alias("c")).select("at", "c.*")


def _block() -> Column:
    return F.least(F.floor(F.col("rank") * F.col("n_blocks")), F.col("n_blocks") - 1).cast("long")


def sampled(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``more`` (1 or 0: in the sample or not) to ``rows``, which also
    have ``level``, as ``cuts`` do, and ``row``, a row number."""
    c = cuts.select(F.col("at").alias("_at"), F.col("level").alias("_level"), F.col("block").alias("_block"),
                    F.col("rank").alias("_rank"), F.col("size").alias("_size"),
                    F.col("take").alias("_take"), F.col("n").alias("_n"))
    joined = rows.join(c, (rows.at == c._at) & (rows.level == c._level), "left")
    block = _block()
    pair, edge = F.struct("rank", "size"), F.struct(F.col("_rank"), F.col("_size"))
    inside = (block < F.col("_block")) | ((block == F.col("_block")) & (pair < edge))
    tied = (block == F.col("_block")) & (pair == edge)
    if not cuts.filter("take > 0 and take < n").limit(1).count():
        more = inside | (tied & (F.col("_take") == F.col("_n")))
        return joined.select(*rows.columns, F.coalesce(more.cast("int"), F.lit(0)).alias("more"))
    # Copies of one document at the edge: the first ones by row number. They
    # are counted by the partition their row number names.
    ties = joined.filter(tied).select(F.struct("at", "level").alias("at"), "row", F.shiftright("row", 33).alias("_p"))
    per = ties.groupBy("at", "_p").agg(F.count(F.lit(1)).alias("_m"))
    before = per.select(F.col("at").alias("_a"), F.col("_p").alias("_q"), F.coalesce(F.sum("_m").over(
        Window.partitionBy("at").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("at", "_p").orderBy("row"))
    placed = ties.withColumn("_nth", nth).join(before, (F.col("at") == F.col("_a"))
                                               & (F.col("_p") == F.col("_q"))) \
        .select(F.col("row").alias("_tied"), (F.col("_before") + F.col("_nth")).alias("_place"))
    more = inside | (tied & (F.col("_place") <= F.col("_take")))
    return joined.join(placed, joined.row == placed._tied, "left") \
        .select(*rows.columns, F.coalesce(more.cast("int"), F.lit(0)).alias("more"))


def with_last_document(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rows`` with one document of each source changed: the one whose size
    closes the gap (``aim``: words still wanted, or too many) best, if any
    does. It is taken into the sample or put back."""
    g = gaps.select(F.col("at").alias("_at"), F.col("aim").alias("gap"))
    fits = F.col("open") & (F.col("more") == (F.col("gap") < 0).cast("int"))
    miss = F.abs(F.abs("gap") - F.col("size"))
    last = rows.join(g, rows.at == g._at).filter(fits & (miss < F.abs("gap"))).groupBy("at").agg(
        F.min_by("row", F.struct(miss, F.col("rank"), F.col("row"))).alias("_last")) \
        .withColumnRenamed("at", "_at")
    return rows.join(last, rows.at == last._at, "left").withColumn(
        "more", F.when(F.col("row") == F.col("_last"), 1 - F.col("more")).otherwise(F.col("more"))) \
        .select(*rows.columns)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        importance: Column | None = None, seed: str = SEED) -> DataFrame:
    """Per input row: ``id_col``, ``source``, ``size`` (words), ``source_size``,
    ``target``, ``copies`` (0 to ``max_repeats``) and ``taken`` (words the mix
    takes from the row, repeats counted).

    ``importance`` (positive numbers; default: 1 for all) makes documents of a
    source more or less likely; null counts as 1, what is not positive as 0.
    The words taken of a source differ from its target by less than half of a
    document at its edge; one last document is chosen to close that gap. Null and empty texts have size 0; null sources are one source, the
    last; null and repeated ids and repeated rows are rows like others (of
    equal rows, which one is taken more often is left open); other columns
    are ignored; an empty table gives an empty result.
    """
    weight = F.lit(1.0) if importance is None else \
        F.greatest(F.coalesce(importance.cast("double"), F.lit(1.0)), F.lit(0.0))
    sized = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), weight.alias("importance"),
        uniform(seed, F.col(id_col), F.col(text)).alias("u"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("size") * F.col("importance")).alias("mass"))
    targets = source_targets(totals.select("source", "source_size"), weights, max_repeats)
    per = targets.alias("t").join(totals.alias("n"), F.expr("t.source <=> n.source")).select(
        F.col("t.source").alias("_source"), "t.source_size", "t.at", "t.target",
        F.greatest(F.ceil(F.col("n") / ROWS_PER_BLOCK), F.lit(1)).cast("long").alias("n_blocks"),
        F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0).alias("rate"))
    per = materialize(per, "targets")
    wanted = F.least(F.col("rate") * F.col("importance"), F.lit(float(max_repeats)))
    level = F.lit(len(LEVELS))
    for k, share in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col("size") > F.col("target") * share, k).otherwise(level)
    ranked = sized.join(per, F.col("source").eqNullSafe(F.col("_source"))) \
        .withColumn("wanted", wanted).withColumn("whole", F.floor("wanted").cast("long")) \
        .withColumn("rank", pareto_rank(F.col("u"), F.col("wanted") - F.col("whole"))) \
        .select("id", "source", "at", "size", "row", "whole", "rank", "n_blocks",
                level.alias("level"),
                ((F.col("whole") < max_repeats) & (F.col("size") > 0)
                 & (F.col("importance") > 0)).alias("open"))
    ranked = materialize(ranked, "ranked")

    # Words the sample is to take, and the words of each level it takes them from.
    certain = ranked.groupBy("at").agg(
        F.sum(F.col("whole") * F.col("size")).alias("certain"),
        *[F.sum(F.when(F.col("open") & (F.col("level") == k), F.col("size")).otherwise(0))
          .alias(f"in{k}") for k in range(len(LEVELS) + 1)])
    left = materialize(per.join(certain, "at").select("at", F.greatest(
        F.col("target") - F.col("certain"), F.lit(0.0)).alias("aim"),
        *[f"in{k}" for k in range(len(LEVELS) + 1)]), "aims")
    open_rows, cuts = ranked.filter("open"), []
    for k in range(len(LEVELS) + 1):
        # This level's part of what is still left; what it misses is carried on.
        below = sum((F.col(f"in{j}") for j in range(k + 1, len(LEVELS) + 1)), F.col(f"in{k}"))
        aims = left.filter(F.col(f"in{k}") > 0).select(
            "at", (F.col("aim") * F.col(f"in{k}") / below).alias("aim"))
        cuts.append(materialize(cut_points(open_rows.filter(F.col("level") == k), aims)
                                .withColumn("level", F.lit(k)), "cuts"))
        got = cuts[-1].select("at", "got")
        left = materialize(left.join(got, "at", "left").withColumn(
            "aim", F.col("aim") - F.coalesce("got", F.lit(0))).drop("got"), "aims")
    every = cuts[0]
    for cut in cuts[1:]:
        every = every.unionByName(cut)
    told = sampled(open_rows, every).unionByName(
        ranked.filter(~F.col("open")).withColumn("more", F.lit(0)))
    told = with_last_document(told, left)
    copies = F.col("whole") + F.col("more")
    facts = per.select(F.col("at").alias("_at"), "source_size", "target")
    return told.join(facts, F.col("at") == F.col("_at")).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
