"""Transcripts from one row per turn.

The turns of an ordinary call are one small group. Calls with more than ``TURNS_PER_CALL`` turns,
be it a runaway recording or a wrong key that holds a third of all rows, are put in order by a range
partitioning of (call, turn, line) instead: it cuts a call anywhere, even among turns that share
one number or one text. Every turn then has its place in the whole order, blocks are cut by place,
and running lengths are sums per part plus sums within a part. Equal turn numbers follow the text
of their lines; null numbers come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.operators.prepare import truncate_transcript
from duecall.session import written
from duecall.vocabulary import MAX_TRANSCRIPT_CHARS

SPEAKERS = {"assistant": "Agent", "user": "Borrower", "system": "System"}
TURNS_PER_CALL = 10_000
TURNS_PER_BLOCK = 256
# lists of long calls up to this many rows go to every task
MOST_BROADCAST = 100_000


def _speaker(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return F.coalesce(F.element_at(known, role), F.initcap(role), F.lit("Unknown"))


def _in_order(pieces: Column, text: str) -> Column:
    ordered = F.array_sort(F.collect_list(pieces))
    return F.array_join(F.transform(ordered, lambda piece: piece[text]), " ")


def _lines(turns: DataFrame) -> DataFrame:
    """Adds ``_line``, the turn as it reads in the transcript."""
    line = F.concat(_speaker(F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("_line", line)


def _split_by_length(
    lines: DataFrame, call: str, most: int
) -> tuple[DataFrame, DataFrame | None]:
    """Lines of calls with at most ``most`` turns, and those of the others if there are any."""
    long = written(
        lines.groupBy(F.col(call).alias("_call"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > most)
        .select("_call"),
        "long_calls",
    )
    n = long.count()
    if not n:
        return lines, None
    listed = F.broadcast(long) if n <= MOST_BROADCAST else long
    same = F.col(call).eqNullSafe(F.col("_call"))
    return lines.join(listed, same, "left_anti"), lines.join(listed, same, "left_semi")


def in_whole_order(lines: DataFrame, call: str) -> DataFrame:
    """``call``, ``_line`` and ``_place`` in the order of (call, turn, line) over all rows.

    A place is the number of a part times 2^33 plus the place in it. Rows alike in everything are
    told apart by a number of their own, so no key can fill a part; the result is written, as the
    parts must stay what they are.
    """
    order = [F.col(call), F.col("turn"), F.col("_line"), F.col("_row")]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = lines.select(call, "turn", "_line").withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = dealt.select(call, "_line", F.monotonically_increasing_id().alias("_place"))
    return written(placed, "turns")


def _block(place: Column) -> Column:
    """Number of a run of neighbouring places within one part; grows with the place."""
    return F.floor(place / TURNS_PER_BLOCK)


def _joined_in_blocks(placed: DataFrame, call: str) -> DataFrame:
    blocks = placed.groupBy(call, _block(F.col("_place")).alias("_block")).agg(
        _in_order(F.struct("_place", F.col("_line").alias("line")), "line").alias("_text"),
        F.count(F.lit(1)).alias("_turns"),
    )
    return blocks.groupBy(call).agg(
        _in_order(F.struct("_block", F.col("_text").alias("line")), "line").alias("transcript"),
        F.sum("_turns").alias("turns"),
    )


def _joined(lines: DataFrame, call: str) -> DataFrame:
    return lines.groupBy(call).agg(
        _in_order(F.struct("turn", F.col("_line").alias("line")), "line").alias("transcript"),
        F.count(F.lit(1)).alias("turns"),
    )


def assemble_transcripts(
    turns: DataFrame, call: str = "conv_id", turns_per_call: int = TURNS_PER_CALL
) -> DataFrame:
    """Whole transcript of every call as ``Agent: … Borrower: …``, and its number of turns.

    ``turns`` has the call key, ``turn`` (its position), ``role`` and ``text``. The transcript of
    a call is one value by nature; use ``assemble_for_prompt`` where a key may hold more turns
    than one call can have.
    """
    short, long = _split_by_length(_lines(turns), call, turns_per_call)
    whole = _joined(short, call)
    if long is None:
        return whole
    return whole.union(_joined_in_blocks(in_whole_order(long, call), call))


def _shown(placed: DataFrame, call: str, limit: int) -> DataFrame:
    """Lines of the blocks that start within the first ``limit`` characters of their call."""
    place = F.col("_place")
    blocks = placed.groupBy(
        call, F.shiftright(place, 33).alias("_part"), _block(place).alias("_block")
    ).agg(F.sum(F.length("_line") + 1).alias("_chars"))
    earlier = Window.unboundedPreceding, -1
    within = Window.partitionBy(call, "_part").orderBy("_block").rowsBetween(*earlier)
    # a call has no more parts than the order has
    parts = (
        blocks.groupBy(F.col(call).alias("_call"), F.col("_part").alias("_of"))
        .agg(F.sum("_chars").alias("_all"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_all").over(Window.partitionBy("_call").orderBy("_of").rowsBetween(*earlier)),
                F.lit(0),
            ),
        )
    )
    same = F.col(call).eqNullSafe(F.col("_call")) & (F.col("_part") == F.col("_of"))
    start = F.col("_start") + F.coalesce(F.sum("_chars").over(within), F.lit(0))
    past = (
        blocks.join(parts, same)
        .select(F.col(call).alias("_call"), "_block", start.alias("_start"))
        # the character before a block is the space that joins it
        .where(F.col("_start") > limit + 1)
        .select("_call", F.col("_block").alias("_past"))
    )
    return placed.join(
        past,
        F.col(call).eqNullSafe(F.col("_call")) & (_block(place) == F.col("_past")),
        "left_anti",
    )


def assemble_for_prompt(
    turns: DataFrame,
    call: str = "conv_id",
    limit: int = MAX_TRANSCRIPT_CHARS,
    turns_per_call: int = TURNS_PER_CALL,
) -> DataFrame:
    """The same as truncating the whole transcript to ``limit`` characters, without building it.

    In a long call, summed lengths tell where each block of turns starts. Turns of blocks that
    start past the limit cannot show in the result and are left out before anything is collected,
    so a key that wrongly holds very many turns costs no more than one call.
    """
    short, long = _split_by_length(_lines(turns), call, turns_per_call)
    whole = _joined(short, call)
    if long is not None:
        shown = _shown(in_whole_order(long, call), call, limit)
        whole = whole.union(_joined_in_blocks(shown, call))
    return whole.select(
        call, truncate_transcript(F.col("transcript"), limit).alias("transcript")
    )
