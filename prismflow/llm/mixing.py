"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the total, but no more than `epochs` times its own size;
what a clamped source cannot take is shared by weight among the others until no source is above its cap.
That fixed point is found in closed form over the table of sources (one row each), ordered by cap/weight.

Every document is taken floor(target / size) times in whole. What then remains of the target is drawn in
seeded order: documents come in the order of md5(seed, id), those that fit below the remainder get one
more whole repetition, and the one document at the cut gets the fraction that is left. The cut is found
by three rounds of counting in 256 buckets of the md5, so that no source is ever gathered in one task.

Documents without id are drawn by their source and text, so that they too spread over the buckets.

Defined results: null text has size 0; null sources form one source, last in code-point order; a source
of size 0 has target 0; repeated rows are documents of their own whose order among themselves is free;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.llm.common import materialize, named, new_names, word_count

#: Weights that repeat over the sources, and the largest number of epochs.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: A plan of at most so many sources (one row each) is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources (source, source_size) with weight: the given ones in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int")))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, weight). A handful of rows: one per source."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    tally = (
        sources.withColumn("budget", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * epochs).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # in this order the first source whose share of what is left is within its cap ends the clamping
    left = F.col("budget") - F.col("capped")
    free = left * F.col("weight") <= F.col("source_size") * epochs * F.col("open_weight")
    level = tally.withColumn("first_free", F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), left.alias("l"), F.col("open_weight").alias("w")))).over(every))
    share = F.col("first_free.l") * F.col("weight") / F.col("first_free.w")
    target = F.when(F.col("first_free").isNull(), (F.col("source_size") * epochs).cast("double")).otherwise(F.least(share, (F.col("source_size") * epochs).cast("double")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words), whole (repetitions), row_key, draw, cut."""
    drawn = _draw(seed, id_col, text_col, source_col)
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), drawn.alias("draw"), _row_key(id_col, text_col, source_col).alias("row_key")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(cycled_weights(totals, weights), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit(""))
    plan = materialize(plan, "targets")
    for _ in range(3):  # each round adds a byte to the part of the md5 at which the remainder ends
        plan = materialize(_narrowed(sized, plan), "cut")
    here = sized.join(_small(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    head = F.substring("draw", 1, 6)
    inside = here.filter(head == F.col("cut"))
    line = Window.partitionBy("source").orderBy("draw", "doc_id", "row_key")  # documents of one in 16.7 million buckets
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))))
    inside = inside.withColumn("extra", partial)
    outside = here.filter(head != F.col("cut")).withColumn("extra", F.when(head < F.col("cut"), F.col("size")).otherwise(0))
    both = outside.unionByName(inside)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "whole", "row_key", "draw", "cut")


def _narrowed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the next byte of each source's cut, and what is left of the remainder inside it."""
    here = sized.join(_small(plan), sized["source"].eqNullSafe(plan["source"])).filter(F.col("draw").startswith(F.col("cut")))
    counts = here.groupBy(sized["source"].alias("of"), F.substring(F.col("draw"), F.length("cut") + 1, F.lit(2)).alias("byte")).agg(F.sum("size").alias("n"))
    by = Window.partitionBy("of").orderBy("byte")
    sums = counts.withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rests = plan.select(F.col("source").alias("whose"), "rest")
    joined = sums.join(_small(rests), F.col("of").eqNullSafe(F.col("whose")))
    reached = joined.filter(F.col("upto") > F.col("rest")).groupBy("of").agg(F.min(F.struct("byte", (F.col("upto") - F.col("n")).alias("below"))).alias("at"))
    out = plan.join(reached, plan["source"].eqNullSafe(reached["of"]), "left")
    # no bucket goes beyond the remainder: everything is taken, the cut lies after the last md5
    return out.select(
        "source", "source_size", "weight", "target", "whole",
        (F.col("rest") - F.coalesce(F.col("at.below"), F.lit(0))).alias("rest"),
        F.concat("cut", F.coalesce(F.col("at.byte"), F.lit("~~"))).alias("cut"),
    )


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """128 bits of a row's id, source and text, nulls apart from empty values."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("null")) for c in (F.col(x).cast("string") for x in (id_col, source_col, text_col))]
    return F.unhex(F.md5(F.concat(*parts)))


def _draw(seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    """A document's place in the seeded order, as hexadecimal digits."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.hex(_row_key(id_col, text_col, source_col))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def mixed_documents(docs: DataFrame, mixed: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with the input's columns: whole repetitions, then the cut one, if any.

    What a row takes follows from its source's plan and its own draw; only rows in the bucket of their source's
    cut are looked up by their key. Rows of one key there are alike but for what they take (all, a part or
    nothing of a last repetition), and it is theirs by turns, so that each row meets one count. The cut
    repetition has the document's first words, white space kept. seed is that of the mix.
    """
    at_cut = F.substring("draw", 1, 6) == F.col("cut")
    plan = materialize(mixed.groupBy("source").agg(F.first("whole").alias("whole"), F.first("cut").alias("cut")), "plan")
    counts = mixed.filter(at_cut).groupBy("row_key", "taken").agg(F.count(F.lit(1)).alias("n")).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("taken", "n"))).alias("turns"))
    turns = materialize(counts, "turns")
    head, size, key, whole, cut, turn, taken, k, source, of_key = new_names(10)
    plan = plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut))
    keyed = turns.select(F.col("row_key").alias(of_key), F.col("turns").alias(turn))
    rows = docs.select("*", F.substring(_draw(seed, id_col, text_col, source_col), 1, 6).alias(head), word_count(text_col).alias(size), _row_key(id_col, text_col, source_col).alias(key))
    rows = rows.join(plan, F.col(source_col).eqNullSafe(F.col(source))).join(keyed, F.col(key) == F.col(of_key), "left")
    base = F.col(whole) * F.col(size)
    plain = F.when(F.col(head) < F.col(cut), base + F.col(size)).otherwise(base)
    alike = rows.filter(F.coalesce(F.size(turn), F.lit(0)) < 2).withColumn(taken, F.coalesce(F.get(F.col(turn), F.lit(0))["taken"], plain))
    if turns.filter(F.size("turns") > 1).limit(1).count():
        place = F.row_number().over(Window.partitionBy(key).orderBy(key))  # repeated rows at a cut
        upto = f"transform({turn}, (x, i) -> struct(x.taken AS taken, aggregate(slice({turn}, 1, i + 1), 0L, (s, y) -> s + y.n) AS upto))"
        by_turns = rows.filter(F.size(turn) > 1).withColumn(taken, place)
        alike = alike.unionByName(by_turns.withColumn(taken, F.expr(f"filter({upto}, x -> x.upto >= {taken})[0].taken")))
    copies = F.when(F.col(size) > 0, F.ceil(F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    rows = alike.withColumn(k, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    words = F.least(F.col(size), F.col(taken) - (F.col(k) - 1) * F.col(size))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col(size), first).otherwise(F.col(text_col))
    return rows.select(*[(text if c == text_col else named(c)).alias(c) for c in docs.columns])
