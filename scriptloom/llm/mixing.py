"""Mixing sources to target weights by entropy balancing.

Each document gets a rate exp(sum of its multipliers), one multiplier per value of each
margin (here: its source). Of all rates that meet the token targets these are the closest,
in relative entropy weighted by tokens, to taking every document once. The multipliers
minimise a convex dual; Newton steps on it are taken margin by margin, where its Hessian is
diagonal, as aggregates over a table with one row per combination of margin values.

Rates become copies by systematic rounding along the documents of a combination in order of
size: a document gets its rate rounded up or down, and a source's tokens miss its target by
no more than about its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ranked, remove, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most this multiple of what its source holds.
MOST_COPIES = 3.0
#: Offsets of the rounding that are tried for each source.
OFFSETS = 32
#: Newton stops when no margin misses its target by more than this share.
TOLERANCE = 1e-10
MOST_SWEEPS = 200
#: Longest Newton step of a multiplier, which keeps steps from far away from overshooting.
LONGEST_STEP = 2.0


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) with `weight` and `target`; sources in code point order, null last.

    The targets share the sum of all sizes by weight. One above `most` times its source's
    size stops there, and the excess goes to the others by weight until none is above.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows, bases = ranked(sources.withColumn("all", F.lit(0)), ["all"], order, "mix-sources")
    place = (F.col("base") + F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    weighed = rows.join(bases.select("part", "base"), "part").select("source", "source_size", weight.alias("weight"))
    weighed, _ = stored(weighed, "mix-weights")
    cap = F.col("source_size") * most
    total = weighed.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        now = weighed.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if now["n"] == capped or not now["free"]:
            break
        capped, level = now["n"], (total - now["fixed"]) / now["free"]
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def entropy_balance(cells: DataFrame, margins: dict[str, DataFrame], size: str = "size") -> DataFrame:
    """Adds `rate` to the cells, so that each margin's tokens meet its targets.

    `cells` has one row for each combination of margin values that occurs, with its tokens;
    `margins` gives, for the name of each margin column, a frame (value, target). A value
    with target 0 gets rate 0; one without tokens leaves the others alone. Several margins
    must agree on their sums, or no rates meet all of them and the sweeps end undecided.
    """
    state = cells.withColumn("multiplier", F.lit(0.0))
    for name, targets in margins.items():
        goal = targets.select(F.col(name).alias("v"), F.col("target").alias(f"target_{name}"))
        state = state.join(goal, F.col(name).eqNullSafe(F.col("v")), "left").drop("v")
    state, path = stored(state, "mix-newton")
    for _ in range(MOST_SWEEPS):
        worst = 0.0
        for name in margins:
            taken = F.col(size) * F.exp("multiplier")
            goal = F.col(f"target_{name}")
            # With rates exp(multiplier) the diagonal of the Hessian is the tokens taken.
            step = state.groupBy(name).agg(F.sum(taken).alias("taken"), F.max(goal).alias("goal"))
            step = step.select(
                F.col(name).alias("v"),
                F.when(
                    (F.col("taken") > 0) & (F.col("goal") > 0),
                    F.greatest(
                        F.least((F.col("goal") - F.col("taken")) / F.col("taken"), F.lit(LONGEST_STEP)),
                        F.lit(-LONGEST_STEP),
                    ),
                ).alias("step"),
                F.when(F.col("goal") > 0, F.abs(F.col("goal") - F.col("taken")) / F.col("goal")).alias("miss"),
            )
            step, step_path = stored(step, "mix-step")
            worst = max(worst, step.agg(F.max("miss").alias("m")).first()["m"] or 0.0)
            moved = (
                state.join(step.select("v", "step"), F.col(name).eqNullSafe(F.col("v")), "left")
                .withColumn("multiplier", F.col("multiplier") + F.coalesce("step", F.lit(0.0)))
                .drop("v", "step")
            )
            old = path
            state, path = stored(moved, "mix-newton")
            for spent in (old, step_path):
                remove(state.sparkSession, spent)
        if worst <= TOLERANCE:
            break
    none = F.lit(False)
    for name in margins:
        none = none | F.coalesce(F.col(f"target_{name}") <= 0, F.lit(True))
    return state.withColumn("rate", F.when(none, 0.0).otherwise(F.exp("multiplier"))).drop("multiplier")


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document (doc_id, source, size): how often the mix takes it.

    Adds source_size, target (of its source), rate, copies and taken = copies * size. No
    document is taken more than three times. A null size counts as 0; a null source is a
    source of its own, last in order; repeated rows count each. An empty table stays empty.
    The same rows give the same copies, however they are partitioned, as ties in size are
    broken by a hash of the id.
    """
    narrow = docs.select(
        "doc_id",
        "source",
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("tie"),
    )
    order = [F.col("size"), F.col("tie"), F.col("doc_id")]
    rows, bases = ranked(narrow, ["source"], order, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sums, _ = stored(sums, "mix-sums")
    targets, _ = stored(source_targets(sums), "mix-targets")
    cells = sums.select("source", F.col("source_size").alias("size"))
    rates = entropy_balance(cells, {"source": targets}).select(
        F.col("source").alias("s"), F.least("rate", F.lit(MOST_COPIES)).alias("rate")
    )
    goals = targets.select(F.col("source").alias("g"), "source_size", "target")
    starts = (
        bases.join(rates, F.col("source").eqNullSafe(F.col("s")))
        .join(goals, F.col("source").eqNullSafe(F.col("g")))
        .select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base", "rate", "source_size", "target")
    )
    placed = rows.join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))
    ).withColumn("rank", F.col("base") + F.col("place"))
    # Of a few offsets of the rounding, each source uses the one that meets its target best.
    misses = placed.groupBy("_s").agg(
        *[
            (F.first("target") - F.sum(_copies(F.lit(k / OFFSETS)) * F.col("size"))).alias(f"m{k}")
            for k in range(OFFSETS)
        ]
    )
    tried = [
        F.struct(F.abs(f"m{k}").alias("size"), F.lit(k / OFFSETS).alias("offset"), F.col(f"m{k}").alias("miss"))
        for k in range(OFFSETS)
    ]
    offsets, _ = stored(
        misses.select(F.col("_s").alias("s"), F.array_min(F.array(*tried)).alias("best")).select(
            "s", "best.offset", "best.miss"
        ),
        "mix-offsets",
    )
    starts = starts.join(offsets, F.col("_s").eqNullSafe(F.col("s"))).drop("s")
    placed = (
        rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        .withColumn("rank", F.col("base") + F.col("place"))
        .withColumn("copies", _copies(F.col("offset")))
    )
    # Then the one document whose rounding the other way mends most of what is missed.
    down = F.col("copies") > F.floor("rate")
    change = F.when(down, -1).when(F.col("copies") + 1 <= MOST_COPIES, 1).otherwise(0)
    left = F.abs(F.col("miss") - change * F.col("size"))
    mends = placed.groupBy("_s").agg(
        F.min(F.struct(left.alias("left"), F.col("rank"), change.alias("change"))).alias("mend"),
        F.first("miss").alias("m"),
    )
    mends, _ = stored(
        mends.where("mend.left < abs(m)").select(F.col("_s").alias("s"), "mend.rank", "mend.change"), "mix-mends"
    )
    mends = mends.withColumnsRenamed({"rank": "mend_rank"})
    starts = starts.join(mends, F.col("_s").eqNullSafe(F.col("s")), "left").drop("s")
    mended = F.when(F.col("rank") == F.col("mend_rank"), F.col("change")).otherwise(0)
    return (
        rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        .withColumn("rank", F.col("base") + F.col("place"))
        .withColumn("copies", _copies(F.col("offset")) + mended)
        .select(
            "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
            "source", "rate", "copies",
        )
    )


def _copies(offset: Column) -> Column:
    """Copies of the document at `rank` when cumulated rates are rounded down from `offset` on."""
    upto = F.col("rate") * F.col("rank") + offset
    before = F.col("rate") * (F.col("rank") - 1) + offset
    return (F.floor(upto) - F.floor(before)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def take_copies(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names, each as often
    as it is taken.

    Rows that share id, source and number of words are taken equally often.
    """
    plan = mix(with_sizes(docs), seed).groupBy(
        F.col("doc_id").alias("_plan_id"), F.col("source").alias("_plan_source"), F.col("size").alias("_plan_size")
    ).agg(F.max("copies").cast("int").alias("_copies"))
    # The input goes along as one column, so that no name of it clashes.
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
    )
    same = (
        F.col("_id").eqNullSafe(F.col("_plan_id"))
        & F.col("_source").eqNullSafe(F.col("_plan_source"))
        & (F.col("_size") == F.col("_plan_size"))
    )
    taken = own.join(plan.where("_copies > 0"), same)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
