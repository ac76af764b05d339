"""Chat formatting of logged conversations, in DataFrame functions only.

Logs often hold cumulative snapshots: a conversation is saved after each turn, so most saved ones are the beginning of a
longer one. Every turn gets a hash of all turns up to it (their roles, texts and places). A conversation whose whole hash
is some longer one's prefix hash is dropped by an anti-join; of equal ones the smallest conv_id stays. What remains is
rendered turn by turn, which is all the template needs, so a conversation of any length is never gathered in one row.

Prefix hashes combine by XOR, so they are built in two steps, inside chunks of a conversation and over the chunks before.
Equal turns of a conversation are counted instead of sorted, and a range of turn numbers with over `CROWD` different turns is
parted by turn number and hash range, so a conversation that holds a third of all rows is spread over many tasks, even if
its turn numbers are null or repeat. Two 64-bit hashes and the number of turns make one key. Only hashes go through these
steps: texts meet their places at the end, to be rendered.

Nulls and odd cases: turns are put in order by turn (null first); turns with the same number by a hash of role and text.
A null role or text is an empty one. Rows with a null conv_id are one conversation, whose id counts as larger than any
other. Repeated rows are repeated turns. Texts of any length are hashed and rendered whole. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

#: Turn numbers of a range, and places of a chunk; different turns up to which a range is sorted as a whole.
CHUNK, CROWD = 256, 4096
START, END = "<|im_start|>", "<|im_end|>"
#: What stands for them inside a message, which so cannot end its turn.
START_TEXT, END_TEXT = "<|im_start_|>", "<|im_end_|>"


def _clean(turns: DataFrame) -> DataFrame:
    """Typed columns without nulls in role and text, and two hashes of role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    typed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         text("role").alias("role"), text("text").alias("text"))
    return typed.withColumns({
        "t1": F.xxhash64(F.lit(1), "role", "text"),
        "t2": F.xxhash64(F.lit(2), F.length("role"), "text", "role"),
    })


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` with the columns that `right` has for the same keys; null keys match."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    alike = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, alike, how).drop(*[f"_{k}" for k in keys])


def places(turns: DataFrame, chunk: int = CHUNK, crowd: int = CROWD) -> DataFrame:
    """conv_id, turn, t1, t2 and place (from 1) of every turn."""
    # Equal turns are one row with their number: they follow each other, so none needs to be told from the next.
    alike = written(_clean(turns).groupBy("conv_id", "turn", "t1", "t2").agg(F.count("*").alias("n")).withColumn(
        "range", F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), F.lit(-(1 << 62)))), "alike")
    sizes = alike.groupBy("conv_id", "range").agg(F.count("*").alias("size")).where(F.col("size") > crowd)
    # How many leading bits of the hash part one turn number's rows, so that a part holds about `crowd` of them.
    crowded = written(sizes.select("conv_id", "range", F.ceil(F.log2(F.col("size") / crowd)).cast("int").alias("bits")), "crowded")
    parted = _joined(alike, crowded, ["conv_id", "range"], "left")
    # In the order of (turn, t1): a crowded range is parted by both.
    part = F.when(F.col("bits").isNotNull(), F.struct("turn", F.expr("shiftright(t1, 64 - bits)").alias("of_hash")))
    parted = written(parted.select("conv_id", "turn", "t1", "t2", "n", "range", part.alias("part")), "parted")
    sums = parted.groupBy("conv_id", "range", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = written(sums.select("conv_id", "range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "earlier")
    inside = Window.partitionBy("conv_id", "range", "part").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = parted.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    based = _joined(ranked, earlier, ["conv_id", "range", "part"]).select(
        "conv_id", "turn", "t1", "t2", "n", (F.col("earlier") + F.col("rank")).alias("base"))
    # A turn's copies, a thousand at a time, so that many copies are dealt out before they are all there.
    blocks = based.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))).alias("at"))
    dealt = blocks.repartition("conv_id", "turn", "t1", "at")
    copies = F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + 1000, F.col("n"))))
    return dealt.select("conv_id", "turn", "t1", "t2", "base", copies.alias("copy")).select(
        "conv_id", "turn", "t1", "t2", (F.col("base") + F.col("copy")).alias("place"))


def prefix_hashes(placed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per turn of `places` (stored): conv_id, place, its hashes h1 and h2, and those of all turns up to it, p1 and p2."""
    hashed = placed.select("conv_id", "place", F.floor((F.col("place") - 1) / chunk).alias("chunk"),
                           F.xxhash64("place", "t1").alias("h1"), F.xxhash64("t2", "place").alias("h2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = written(sums.select("conv_id", "chunk", *[
        F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))]), "carried")
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("*", F.bit_xor("h1").over(so_far).alias("x1"), F.bit_xor("h2").over(so_far).alias("x2"))
    return _joined(inside, carried, ["conv_id", "chunk"]).select(
        "conv_id", "place", "h1", "h2", F.col("x1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("p2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations to keep."""
    whole = prefixes.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    # Equal conversations: one row per key, with how many there are.
    alike = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("same"))
    # A key that more conversations pass through than end with begins a longer one.
    passing = prefixes.groupBy(F.col("place").alias("n_turns"), "p1", "p2").agg(F.count("*").alias("passing"))
    longer = alike.join(passing, ["n_turns", "p1", "p2"]).where("passing > same").select("n_turns", "p1", "p2")
    return alike.join(longer, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")


def rendered_turns(turns: DataFrame, chunk: int = CHUNK, crowd: int = CROWD) -> DataFrame:
    """conv_id, place, n_turns and rendered (one turn in the template) of all turns of maximal conversations.

    A conversation's text is its rendered turns in the order of their places.
    """
    placed = written(places(turns, chunk, crowd), "places")
    kept = written(maximal(written(prefix_hashes(placed, chunk), "prefixes")), "maximal")
    of_kept = _joined(placed, kept, ["conv_id"])
    message = F.replace(F.replace("text", F.lit(START), F.lit(START_TEXT)), F.lit(END), F.lit(END_TEXT))
    speaker = F.replace(F.replace("role", F.lit(START), F.lit(START_TEXT)), F.lit(END), F.lit(END_TEXT))
    # Of equal turns one text goes on; joined on the hashes too, a hot conversation's texts spread.
    texts = _joined(_clean(turns), kept.select("conv_id"), ["conv_id"]).dropDuplicates(["conv_id", "turn", "t1", "t2"])
    return _joined(of_kept, texts, ["conv_id", "turn", "t1", "t2"]).select(
        "conv_id", "place", "n_turns",
        F.concat(F.lit(START), speaker, F.lit("\n"), message, F.lit(END + "\n")).alias("rendered"))
