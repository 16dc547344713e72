"""Chat formatting: one rendering of a dialogue for each participant, who speaks as the assistant.

Turns are ordered by (turn, role, text).  In a participant's rendering its own turns have the role
assistant, every other speaker's turns the role user with the speaker's name, and turns of context roles
(system) keep their role in every rendering.  A turn reads "<|role name=speaker|>\\ntext<|end|>\\n"; the mask
covers the text and end mark of the participant's own turns, as character spans of the whole rendering.

A rendering comes in chunks of at most CHUNK turns, each with its place, so that a dialogue of any
length is spread over tasks: rows are dealt by ranges of (conversation, turn, role, text) and then by chunk,
and meet their speakers by broadcast or by conversation and a part of its chunks, never by conversation alone.  The output is as large as participants times turns, which is what is asked for.

Defined results: rows that repeat in all four columns count once; a null text is empty, a null role is
the speaker "unknown", a null turn comes first, null conversation ids form one dialogue; a dialogue of
context turns alone has no participant and gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bound_batches, materialize

CHUNK = 64
#: Chunks whose places one task counts.
STRETCH = 256
#: Speakers of all conversations that are broadcast; of more, each is copied for this many parts of a dialogue's chunks.
SPEAKERS, PARTS = 200_000, 32
CONTEXT_ROLES = ("system",)
END = "<|end|>"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of one partition, without repeats, with the partition and their number in their conversation there.
    Arrow keeps 64-bit ids and turns exact beside nulls."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keep, number = [], []
        for at, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)):
            if now == last:
                continue
            n = n + 1 if last is not None and last[0] == now[0] else 0
            last = now
            keep.append(at)
            number.append(n)
        rows = batch.take(pa.array(keep, pa.int64()))
        columns = [rows.column("conv_id"), pa.array([part] * len(keep), pa.int32()), pa.array(number, pa.int64()), rows.column("role"), rows.column("text")]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n", "role", "text"])


def _chunked(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, turns): turns CHUNK * chunk and on of a conversation.  Rows are dealt by ranges of the
    whole order, then by conversation and chunk, so that no task gets more of a conversation than its share."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(dealt.mapInArrow(_numbered, "conv_id long, part int, n long, role string, text string"))
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), before.alias("before"))
    placed = numbered.join(before, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))).withColumn("pos", F.col("before") + F.col("n"))
    turn = F.struct("pos", "role", "text")
    grouped = placed.groupBy("conv_id", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return materialize(grouped)


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, speaker, chunk, n_turns, start, text, spans, n_masked) of every participant's rendering.

    start: where the chunk begins in the whole rendering, in characters; spans: [start, end) of the mask
    there; chunk numbers from 0 in each rendering.
    """
    bound_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    chunks = _chunked(rows)
    people = chunks.select("conv_id", F.explode(F.array_distinct(F.transform("turns", lambda t: t["role"]))).alias("speaker")).distinct()
    if context_roles:
        people = people.where(~F.col("speaker").isin(*context_roles))
    people = materialize(people.withColumnRenamed("conv_id", "__conv"))

    def head(t):
        context = F.concat(F.lit("<|"), t["role"], F.lit("|>\n")) if context_roles else F.lit("")
        named = F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n"))
        named = F.when(t["role"].isin(*context_roles), context).otherwise(named) if context_roles else named
        return F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(named)

    # places come from lengths alone, so that texts aren't moved for them
    sizes = chunks.select("conv_id", "chunk", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("n"))).alias("turns"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    if people.count() <= SPEAKERS:
        sizes = sizes.join(F.broadcast(people), same)
    else:
        copied = people.withColumn("__part", F.explode(F.array(*map(F.lit, range(PARTS)))))
        sizes = sizes.withColumn("part", F.pmod("chunk", F.lit(PARTS))).join(copied, same & (F.col("part") == F.col("__part")))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(head(t)) + t["n"] + len(END) + 1)
    # sums over stretches of chunks first: no task gets more of a long dialogue than a stretch, or the sums of all
    sizes = materialize(sizes.select("conv_id", "speaker", "chunk", F.expr(f"chunk div {STRETCH}").alias("stretch"), total.alias("total")))
    ahead = lambda window: F.coalesce(F.sum("total").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sizes.groupBy("conv_id", "speaker", "stretch").agg(F.sum("total").alias("total"))
    before = sums.select(F.col("conv_id").alias("__of"), F.col("speaker").alias("__by"), F.col("stretch").alias("__in"), ahead(W.partitionBy("conv_id", "speaker").orderBy("stretch")).alias("before"))
    inside = ahead(W.partitionBy("conv_id", "speaker", "stretch").orderBy("chunk"))
    placed = sizes.withColumn("inside", inside).join(before, F.col("conv_id").eqNullSafe(F.col("__of")) & (F.col("speaker") == F.col("__by")) & (F.col("stretch") == F.col("__in")))
    places = placed.select(F.col("conv_id").alias("__conv"), F.col("chunk").alias("__chunk"), "speaker", (F.col("before") + F.col("inside")).alias("start"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    made = chunks.join(places, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("chunk") == F.col("__chunk"))).select("conv_id", "speaker", "chunk", "start", pieces.alias("pieces"))
    made = made.withColumn("text", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), ""))
    length = lambda p: (F.length(p["head"]) + F.length(p["body"]) + 1).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walk = F.aggregate(
        "pieces", F.struct(F.col("start").alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + length(p)).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + length(p) - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    made = made.withColumn("spans", walk)
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return made.select("conv_id", "speaker", "chunk", F.size("pieces").cast("long").alias("n_turns"), "start", "text", "spans", masked.alias("n_masked"))
