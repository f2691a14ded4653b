"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLOTS = 1 << 19
PARTS = 4096
CELLS = 1024
#: The golden ratio's fractional part; its multiples, modulo 1, spread evenly at every length.
GOLDEN = 0.6180339887498949


def _wide(name: str) -> str:
    """A factor of a product that may not fit 64 bits."""
    return f"cast({name} AS decimal(19,0))"


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size), one row a source: adds weight, cap, target, and the bounds of its share of [0, 1).

    Weights repeat over the sources in code point order, null last. All sources together get ``share`` times all
    sizes. A target stops at ``most`` times its source's size; what is above goes to the others by weight. The sources
    that stop are those with the least cap for their weight, so one ordered pass over the sources finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    every = Window.partitionBy()
    table = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    table = table.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / rest
    turn = F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "rank"))
    table = table.withColumn("level", level).withColumn("turn", turn)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    table = table.withColumn("level", F.min(F.when(fits, F.struct("turn", "level"))).over(every)["level"])
    table = table.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.greatest(F.sum("target").over(every), F.lit(1.0))
    table = table.withColumn("below", F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / whole)
    table = table.withColumn("above", F.when(F.lead("rank").over(order).isNull(), 1.0).otherwise(upto / whole))
    return table.select("source", "rank", "source_size", "target", "below", "above", whole.alias("whole"))


def slot_schedule(targets: DataFrame, most: int, slots: int = SLOTS) -> DataFrame:
    """(slot, rank, turn, n_blocks, block, until): the mix, slot by slot; a source's turn-th use takes its turn-th block.

    Slot t stands at the fraction of t times the golden ratio, and takes the source whose share of [0, 1) holds that
    point. Slots and shares meet in cells of equal width, an equi-join. Each source has one more slot at the end, so
    none is without, and a source of fewer than ``most`` slots has several uses a slot.

    A source takes the words that its slots hold at equal length, settled to a whole number next to its target. It is
    cut into ``n_blocks`` equal blocks, as many as its slots can take; ``block`` counts round them, and ``until`` is
    where the target ends in that round, counted from the source's first word.
    """
    spark = targets.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN)).alias("x")).select("slot", (F.col("x") - F.floor("x")).alias("x"))
    points = points.withColumn("cell", F.least(F.floor(F.col("x") * CELLS), F.lit(CELLS - 1)))
    cells = F.sequence(F.least(F.floor(F.col("below") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("above") * CELLS), F.lit(CELLS - 1)))
    held = targets.where("target > 0")
    columns = ["rank", "source_size", "target", "step"]
    placed = points.join(held.select(*columns, "below", "above", "whole", F.explode(cells).alias("cell")), "cell").where("x >= below AND x < above AND slot * step < whole")
    placed = placed.select("slot", *columns).unionByName(held.select(F.lit(slots).cast("long").alias("slot"), *columns))
    source = Window.partitionBy("rank")
    placed = placed.withColumn("n_slots", F.count("*").over(source)).withColumn("words", F.least(F.greatest((F.col("n_slots") - 1) * F.col("step"), F.floor("target")), F.ceil("target")))
    placed = placed.where("words > 0").withColumn("each", F.expr(f"({most} + n_slots - 1) div n_slots"))
    placed = placed.withColumn("n_blocks", F.expr(f"greatest(least({_wide('n_slots * each')} * {_wide('source_size')} div words, source_size), 1)"))
    turn = (F.row_number().over(source.orderBy("slot")) - 1) * F.col("each")
    placed = placed.withColumn("first", turn).withColumn("turn", F.explode(F.expr("sequence(first, first + each - 1)"))).where(f"{_wide('turn')} * {_wide('source_size')} < {_wide('n_blocks')} * {_wide('words')}")
    return placed.select("slot", "rank", "turn", "n_blocks", F.pmod("turn", "n_blocks").alias("block"), F.expr("words - (turn div n_blocks) * source_size").alias("until"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Returns (id, further columns asked for, size, source_size, target, taken) for every row.

    Each source's rows are put in a pseudorandom order (by a digest of id and text) and cut into blocks of equal words,
    as long as its own slots of the schedule need to hold its target. A row takes, for every use of one of its blocks,
    the words it has in that block; a source's last use is cut at its target, so every source takes its target to
    within a word at every size, and no word is used more than ``most`` times. Offsets within a source come from sums of 4096 parts, so a source with a
    third of all rows is no single task.

    Defined cases: a null text has size 0; a null source is a source, ordered last; an empty source has target 0; rows
    with equal id and text may exchange their places in the order but get the same totals; an empty table gives an
    empty result; extra columns that are not asked for are ignored.
    """
    if clash := [c for c in keep if c.startswith("_") or c in ("size", "source_size", "target", "taken")]:
        raise ValueError(f"columns that are made here cannot be kept: {clash}")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    carried = [c for c in keep if c != text_col]
    given = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("size"), digest.alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in carried])
    given = given.withColumn("_part", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(PARTS)))
    parts = given.groupBy("_source", "_part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, share, most)
    # The length of a slot at which all slots hold all targets.
    targets = targets.withColumn("step", F.greatest(F.ceil(F.col("whole") / F.lit(SLOTS)), F.lit(1)).cast("long"))
    schedule = slot_schedule(targets, most)
    uses = schedule.groupBy("rank", "block").agg(F.count("*").alias("uses"), F.min("until").alias("until"))
    blocks = schedule.groupBy("rank").agg(F.max("n_blocks").alias("n_blocks"))
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("part_start", before).select("_source", "_part", "part_start")
    plan = targets.join(blocks, "rank", "left").select(F.col("source").alias("_source"), "rank", "source_size", "target", "n_blocks")
    starts = starts.join(plan, starts["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    inner = Window.partitionBy("_source", "_part").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = given.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    right = starts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "part_start", "rank", "source_size", "target", "n_blocks")
    placed = placed.join(right, placed["_source"].eqNullSafe(right["_s"]) & (placed["_part"] == right["_p"])).drop("_s", "_p")
    placed = placed.withColumn("_from", F.col("part_start") + F.col("_inner")).withColumn("_row", F.struct("_key", "_from"))
    block_of = lambda word: f"({_wide(word)} * {_wide('n_blocks')} - 1) div source_size"
    start_of = lambda block: f"{_wide(block)} * {_wide('source_size')} div n_blocks"
    met = F.expr(f"sequence({block_of('_from + 1')}, {block_of('_from + size')})")
    pieces = placed.where("size > 0 AND n_blocks IS NOT NULL").select("_key", "_from", "size", "rank", "source_size", "n_blocks", F.explode(met).alias("block"))
    pieces = pieces.withColumn("start", F.expr(f"greatest(_from, {start_of('block')})")).withColumn("end", F.expr(f"least(_from + size, {start_of('block + 1')})"))
    # Only the last use of a block can be cut.
    held = F.expr("(end - start) * (uses - 1) + greatest(least(end, until) - start, 0)")
    taken = pieces.join(uses, ["rank", "block"]).groupBy("_key", "_from").agg(F.sum(held).alias("taken"))
    out = placed.join(taken, ["_key", "_from"], "left")
    if text_col in keep:
        # Rows with one key have one text, so texts meet the finished mix by key: they are shuffled once, and last.
        texts = docs.select(digest.alias("_key"), F.col(text_col).alias(f"_keep_{text_col}")).dropDuplicates(["_key"])
        out = out.join(texts, "_key")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
