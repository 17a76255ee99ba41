"""Chat formatting: one rendering of a dialogue from each participant's seat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import read, saved

#: Turns whose numbers share a block of this size are rendered into one part.
TURNS = 256
#: Rows of one conversation, part and seat that one task renders at most.
ROWS = 4096


def sliced(said: DataFrame) -> DataFrame:
    """``said`` plus slice and copies: parts of more than ``ROWS`` rows cut in turn order.

    Slices are ranges of ``ROWS`` running row numbers over (turn, name, body). Equal rows
    of a large part are one row with their number in that slice as ``copies``. Row
    numbers are running sums per chunk of a range-sorted table plus the sums of the
    chunks before, so no task holds a large part.
    """
    part, order = ["conv_id", "part"], ["turn", "name", "body"]
    sizes = said.groupBy(*part).agg(F.count("*").alias("rows")).filter(F.col("rows") > ROWS)
    large = saved(sizes.select(*part), "large_parts").alias("b")
    here = F.expr("a.conv_id <=> b.conv_id AND a.part = b.part")
    small = said.alias("a").join(large, here, "left_anti").select(
        *part, *order, F.lit(0).cast("long").alias("slice"), F.lit(1).alias("copies")
    )
    keys = said.alias("a").join(large, here, "left_semi").groupBy(*part, *order).agg(F.count("*").alias("n"))
    ranged = saved(
        keys.repartitionByRange(*part, *order).withColumn("chunk", F.spark_partition_id()), "turn_ranges"
    )
    chunks = ranged.groupBy(*part, "chunk").agg(F.sum("n").alias("n"))
    before = chunks.select(
        *part, "chunk", (F.sum("n").over(Window.partitionBy(*part).orderBy("chunk")) - F.col("n")).alias("before")
    ).alias("b")
    upto = Window.partitionBy(*part, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        ranged.withColumn("upto", F.sum("n").over(upto)).alias("a")
        .join(before, F.expr("a.conv_id <=> b.conv_id AND a.part = b.part AND a.chunk = b.chunk"))
        .select(*[f"a.{c}" for c in (*part, *order)], (F.col("before") + F.col("upto")).alias("stop"), "n")
        .withColumn("start", F.col("stop") - F.col("n"))
        .withColumn("slice", F.explode(F.expr(f"sequence(start div {ROWS}, (stop - 1) div {ROWS})")))
    )
    mine = F.least(F.col("stop"), (F.col("slice") + 1) * ROWS) - F.greatest(F.col("start"), F.col("slice") * ROWS)
    return small.unionByName(numbered.select(*part, *order, "slice", mine.cast("int").alias("copies")))


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", turns_per_part: int = TURNS,
) -> DataFrame:
    """Each conversation once per participant, with that participant as assistant.

    Returns (conv_id, seat, part, slice, n_turns, n_trained, text, spans): the text of
    a part has one line-framed message per turn, ``<|assistant|>`` for the seat's own
    turns and ``<|user name=X|>`` for all others; ``spans`` are the [start, stop) code
    points of the seat's messages (the loss mask: 1 inside, 0 outside), counted within
    the row's text.

    A participant is a distinct speaker. A null speaker takes the name ``unknown`` and
    is a participant too; a null text is empty; a null conversation id is a conversation
    of its own. Equal turn numbers are ordered by speaker, then text; repeated rows are
    rendered as often as they occur; a null turn comes first, in part 0. A long
    conversation is cut in parts by turn number, and where a part has more than
    ``ROWS`` rows (many rows of one turn number) in slices of ``ROWS`` rows in the same
    order, so that no task holds a whole hot conversation; the parts joined in (part,
    slice) order are the whole dialogue in turn order. An empty table gives no rows.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(0)).cast("long"))
    seats = said.select("conv_id", F.col("name").alias("seat")).distinct()
    cut = sliced(said)
    own = F.col("name") == F.col("seat")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(
        F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n"))
    )
    seen = (
        cut.alias("a")
        .join(seats.alias("s"), F.expr("a.conv_id <=> s.conv_id"))
        .select(
            "a.conv_id", "seat", "part", "slice",
            F.struct(
                "turn", "name", "body", own.alias("own"),
                F.concat(head, F.col("body"), F.lit("\n<|end|>\n")).alias("line"),
                F.length(head).alias("skip"), "copies",
            ).alias("m"),
        )
    )
    parts = seen.groupBy("conv_id", "seat", "part", "slice").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list("m")), lambda m: F.array_repeat(m, m["copies"]))
        ).alias("ms")
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )

    def step(acc, m):
        start = (acc["at"] + m["skip"]).cast("long")
        span = F.struct(start.alias("start"), (start + F.length(m["body"])).cast("long").alias("stop"))
        return F.struct(
            (acc["at"] + F.length(m["line"])).cast("long").alias("at"),
            F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return parts.select(
        "conv_id", "seat", "part", "slice",
        F.size("ms").cast("long").alias("n_turns"),
        F.size(F.filter("ms", lambda m: m["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("ms", lambda m: m["line"]), "").alias("text"),
        F.aggregate("ms", zero, step)["spans"].alias("spans"),
    )


def query(spark, sf_dir):
    out = rotate(read(spark, sf_dir, "conversations"))
    masks = F.array_join(
        F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ","
    )
    return out.select(
        "conv_id", "seat", "part", "slice", "n_turns", "n_trained", "text", masks.alias("mask")
    )


#: For tables whose (conversation, part) has at most ROWS rows: one slice.
SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS body,
         coalesce(floor(turn / {TURNS}.0), 0)::BIGINT AS part,
         row_number() OVER () AS rid
  FROM conversations),
seats AS (SELECT DISTINCT conv_id, name AS seat FROM said),
seen AS (
  SELECT a.conv_id, seat, part, turn, name, body, rid, name = seat AS own,
         CASE WHEN name = seat THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || name || '|>' || chr(10) END AS head
  FROM said a JOIN seats s ON a.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, head || body || chr(10) || '<|end|>' || chr(10) AS line,
         coalesce(sum(length(head) + length(body) + 9) OVER (
           PARTITION BY conv_id, seat, part ORDER BY turn NULLS FIRST, name, body, rid
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM seen)
SELECT conv_id, seat, part, 0::BIGINT AS slice, count(*)::BIGINT AS n_turns,
       count(*) FILTER (WHERE own)::BIGINT AS n_trained,
       string_agg(line, '' ORDER BY turn NULLS FIRST, name, body, rid) AS text,
       coalesce(string_agg(
         (before + length(head))::BIGINT || '-' || (before + length(head) + length(body))::BIGINT, ','
         ORDER BY turn NULLS FIRST, name, body, rid) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, seat, part
"""
