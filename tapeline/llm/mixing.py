"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import fresh, n_words, read, saved

#: Weights of the sources in code point order, repeating; null last.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
MAX_REPEAT = 3
#: Words of a block: the unit that a slot of the schedule takes.
BLOCK = 256
#: Fixed value: the step of the golden-ratio sequence.
GOLDEN = 0.6180339887498949
#: Documents of one source that one task orders, about; slots that one task ranks, at most.
RUN, CHUNK = 5_000, 65_536
#: Cells that the unit interval is cut into to find a point's source by an equi-join.
CELLS = 4_096
SEED = "mix"


def targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source of ``sized`` (source, size): what the mix takes from it.

    (source, sid, docs, words, weight, target, take): targets share all words by
    weight; one that would exceed ``max_repeat`` times its source's words stops there
    and the excess is shared anew by weight until none is above. In ascending order of
    cap per weight the capped sources are a prefix, so the water level is the first
    (words left) / (weights left) that does not exceed its own source's ratio. ``take``
    is the target in whole words. These are rows per source, not per document.
    """
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = len(weights)
    per = sized.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("size").cast("long").alias("words")
    )
    ranked = (
        per.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % n + 1).cast("int")))
        .withColumn("ratio", F.lit(1.0 * max_repeat) * F.col("words") / F.col("weight"))
    )
    level = (
        (F.sum("words").over(every) - F.coalesce(F.sum(max_repeat * F.col("words")).over(before), F.lit(0)))
        .cast("double") / F.sum("weight").over(from_here)
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)
    return (
        ranked.withColumn("level", level).withColumn("level", first["level"])
        .withColumn(
            "target",
            F.least((F.col("words") * max_repeat).cast("double"), F.col("level") * F.col("weight")),
        )
        .withColumn("take", F.floor("target").cast("long"))
        .select("source", "sid", "docs", "words", "weight", "target", "take")
    )


def _blocks(sources: DataFrame, block: int) -> DataFrame:
    """Adds to each source its blocks and the slots it needs to give its target."""
    per_pass = F.ceil(F.col("words") / block).cast("long")
    rest = F.ceil(F.expr("take % words") / block).cast("long")
    return sources.withColumn("blocks", per_pass).withColumn(
        "slots",
        F.when(F.col("words") == 0, F.lit(0).cast("long")).otherwise(
            F.expr("take div words") * F.col("blocks") + rest
        ),
    )


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The order in which the mix takes blocks: (slot, sid, rank, pass, block, words).

    Point t of the golden-ratio sequence falls into a source's share of the unit
    interval; the k-th point of a source takes its k-th block, pass after pass over the
    source. The sequence fills each share with an error of a few slots; a source's
    points beyond its need are left out, missing ones are added at the end, so every
    source gives its target to the word (the last block of a source is taken in part).
    """
    spark = sources.sparkSession
    s = _blocks(sources, block)
    total = s.agg(F.sum("slots")).first()[0] or 0
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    shares = (
        s.withColumn("upto", F.sum("slots").over(order))
        .filter("slots > 0")
        .withColumn("lo", (F.col("upto") - F.col("slots")).cast("double") / total)
        .withColumn("hi", F.col("upto").cast("double") / total)
        .withColumn(
            "cell",
            F.explode(
                F.sequence(
                    F.floor(F.col("lo") * CELLS),
                    F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")),
                )
            ),
        )
        .select("sid", "lo", "hi", "cell")
    )
    x = (F.col("id") + 1).cast("double") * F.lit(GOLDEN)
    points = spark.range(total).withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * CELLS))
    hits = (
        points.join(shares, "cell")
        .filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        .select("sid", F.col("id").alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk"))
    )
    counts = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ranked = (
        hits.join(starts.select("sid", "chunk", "before"), ["sid", "chunk"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
        .select("sid", "slot", "rank")
    )
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    late = (
        s.join(got, "sid", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter(F.col("got") < F.col("slots"))
        .select("sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
        .select("sid", (F.lit(total) + F.col("rank")).alias("slot"), "rank")
    )
    return (
        ranked.unionByName(late)
        .join(s, "sid")
        .filter(F.col("rank") < F.col("slots"))
        .withColumn("pass", F.expr("rank div blocks"))
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn(
            "words",
            F.least(
                F.lit(block).cast("long"),
                F.col("words") - F.col("block") * block,
                F.col("take") - F.col("pass") * F.col("words") - F.col("block") * block,
            ),
        )
        .select("slot", "sid", "rank", "pass", "block", "words")
    )


def shuffled(sized: DataFrame, sources: DataFrame, seed: str = SEED) -> DataFrame:
    """Places each document in its source's shuffled stream of words: start and stop.

    The order is that of a hash of the id, ties by size. It is found in two levels:
    runs of the hash range hold about ``RUN`` documents each, their sizes are summed
    per source, and only then are documents placed inside their run.
    """
    digest = F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = (
        sized.alias("d")
        .join(sources.select("source", "sid", "docs").alias("s"), F.expr("d.source <=> s.source"))
        .select("d.*", "s.sid", "s.docs")
        .withColumn("digest", digest)
        .withColumn("runs", F.ceil(F.col("docs") / RUN))
        .withColumn(
            "run",
            F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("runs") / F.lit(2**32)).cast("long"),
        )
    )
    sums = docs.groupBy("sid", "run").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("sid", "run", "before")
    inside = Window.partitionBy("sid", "run").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        docs.join(starts, ["sid", "run"])
        .withColumn("stop", (F.col("before") + F.sum("size").over(inside)).cast("long"))
        .withColumn("start", F.col("stop") - F.col("size"))
        .drop("docs", "digest", "runs", "run", "before")
    )


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, body): one row per document; ``body`` is a hash of its text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("body"),
    )


def mix(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: str = SEED):
    """(spans, placed, sources) of the mix of ``sized`` (doc_id, source, size, ...).

    ``spans`` are the words each slot takes from each document: (slot, sid, pass, start,
    stop, word_from, word_to), where (sid, start, stop) names the document as placed in
    its source's stream and word_from/word_to count from the document's first word.
    ``placed`` is ``sized`` with its place; ``sources`` the rows of ``targets``.

    Documents without words are in no slot. A null source is a source of its own;
    repeated rows are documents of their own; an empty table has no slots. The result
    depends on ids, sizes and the seed alone, so reruns agree.
    """
    sources = saved(targets(sized, weights, max_repeat), "mix_sources")
    placed = saved(shuffled(sized, sources, seed), "mix_placed")
    pieces = placed.filter("size > 0").select(
        "sid", "start", "stop",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))).alias("block"),
    )
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("stop"), F.col("block") * block + F.col("words"))
    spans = (
        pieces.join(schedule(sources, block), ["sid", "block"])
        .withColumn("word_from", lo - F.col("start"))
        .withColumn("word_to", hi - F.col("start"))
        .filter("word_from < word_to")
        .select("slot", "sid", "pass", "start", "stop", "word_from", "word_to")
    )
    return spans, placed, sources


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, body, source_size, target, taken, first_slot, last_slot) per document.

    The slots are those of the schedule that take its first and its last words, null for
    a document of which nothing is taken.
    """
    sized = saved(sizes(docs), "mix_sizes")
    spans, placed, sources = mix(sized, **options)
    sums = spans.groupBy("sid", "start", "stop").agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("taken"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
    )
    return (
        placed.join(sums, ["sid", "start", "stop"], "left")
        .join(sources.select("sid", F.col("words").alias("source_size"), "target"), "sid")
        .select(
            "doc_id", "source", "size", "body", "source_size", "target",
            F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
            *[F.when(F.col("size") > 0, F.col(c)).alias(c) for c in ("first_slot", "last_slot")],
        )
    )


def copies(docs: DataFrame, max_repeat: int = MAX_REPEAT, **options) -> DataFrame:
    """(doc_id, source, body, slots) of the rows that the mix takes, ``slots`` one per copy.

    Rows that agree in id, source and text share what was taken from them evenly, to the
    nearest whole copy. Each pass over a source takes a row once, so the k-th least of
    the slots in which passes begin a row is where its k-th copy stands.
    """
    spans, placed, _ = mix(sizes(docs), max_repeat=max_repeat, **options)
    begun = spans.groupBy("sid", "start", "stop", "pass").agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("t"), F.min("slot").alias("slot")
    )
    rows = (
        begun.groupBy("sid", "start", "stop").agg(F.sum("t").alias("t"), F.collect_list("slot").alias("slots"))
        .join(placed.filter("size > 0"), ["sid", "start", "stop"], "right")
        .select("doc_id", "source", "body", "size", F.coalesce("t", F.lit(0)).alias("t"), F.array_sort("slots").alias("slots"))
    )
    least = [F.min(F.get("slots", F.lit(k))).alias(f"s{k}") for k in range(max_repeat)]
    share = rows.groupBy("doc_id", "source", "body").agg(F.sum("t").alias("t"), F.sum("size").alias("s"), *least)
    n = F.round(F.col("t") / F.col("s")).cast("int")
    slots = F.slice(F.array(*[f"s{k}" for k in range(max_repeat)]), F.lit(1), n)
    return share.filter(n > 0).select("doc_id", "source", "body", slots.alias("slots"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them, in the order of the schedule.

    Rows are sorted into ranges by the slots of ``copies``, so files read one after the
    other hold the sources in the proportions of the mix throughout. Rows without words
    are in no slot and go. All columns stay as they are.
    """
    slot = fresh(docs, "_slot")
    on = F.expr("d.doc_id <=> t.doc_id AND d.source <=> t.source AND xxhash64(d.text) = t.body")
    taken_ = saved(copies(docs, **options), "mix_copies").alias("t")
    return (
        docs.alias("d").join(taken_, on).select("d.*", F.explode("t.slots").alias(slot))
        .repartitionByRange(slot).sortWithinPartitions(slot).drop(slot)
    )


def query(spark, sf_dir):
    return taken(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot"
    )


#: ``taken`` is stated without a schedule: whole passes and the head of the last one. The
#: slots come from the ranks of a document's blocks among its source's points.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}-' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source),
w AS (
  SELECT source, words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid,
         list_extract([{", ".join(map(str, WEIGHTS))}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS weight
  FROM per),
r AS (SELECT *, {MAX_REPEAT}::DOUBLE * words / weight AS ratio FROM w),
lv AS (
  SELECT *, (sum(words) OVER () - coalesce(sum({MAX_REPEAT} * words) OVER (
              ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, words,
         least(({MAX_REPEAT} * words)::DOUBLE,
               (SELECT level FROM lv WHERE level <= ratio ORDER BY ratio, sid LIMIT 1) * weight) AS target
  FROM lv),
p AS (
  SELECT s.doc_id, s.source, s.size, t.words, t.target, floor(t.target)::BIGINT AS take,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
b AS (
  SELECT (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS sid, source,
         ((words + {BLOCK - 1}) // {BLOCK})::BIGINT AS blocks,
         CASE WHEN words = 0 THEN 0
              ELSE (floor(target)::BIGINT // words) * ((words + {BLOCK - 1}) // {BLOCK})
                   + (floor(target)::BIGINT % words + {BLOCK - 1}) // {BLOCK} END::BIGINT AS slots
  FROM t),
sh AS (
  SELECT sid, source, slots, blocks, (sum(slots) OVER ())::BIGINT AS total,
         (sum(slots) OVER (ORDER BY sid) - slots)::DOUBLE / sum(slots) OVER () AS lo,
         (sum(slots) OVER (ORDER BY sid))::DOUBLE / sum(slots) OVER () AS hi
  FROM b),
u AS (
  SELECT id, (id + 1)::DOUBLE * {GOLDEN}::DOUBLE - floor((id + 1)::DOUBLE * {GOLDEN}::DOUBLE) AS u
  FROM (SELECT unnest(range(coalesce((SELECT sum(slots) FROM b), 0)::BIGINT)) AS id)),
h AS (
  SELECT sh.sid, u.id AS slot, row_number() OVER (PARTITION BY sh.sid ORDER BY u.id) - 1 AS rank
  FROM u JOIN sh ON u.u >= sh.lo AND u.u < sh.hi),
g AS (SELECT sid, count(*) AS got FROM h GROUP BY sid),
o AS (
  SELECT sid, rank, slot FROM h
  UNION ALL
  SELECT sid, r AS rank, total + r AS slot
  FROM (SELECT sh.sid, sh.total, unnest(range(coalesce(g.got, 0), sh.slots)) AS r FROM sh LEFT JOIN g USING (sid))),
q AS (
  SELECT p.*, sh.sid, sh.blocks,
         CASE WHEN words = 0 THEN 0
              ELSE (take // words) * size + least(size, greatest(0, take % words - start)) END::BIGINT AS taken,
         CASE WHEN words = 0 THEN 0 ELSE take // words END AS passes,
         CASE WHEN words = 0 THEN 0 ELSE take % words END AS rest
  FROM p JOIN sh ON p.source IS NOT DISTINCT FROM sh.source),
e AS (
  SELECT *, start // {BLOCK} AS first_rank,
         CASE WHEN rest > start THEN passes * blocks + (least(start + size, rest) - 1) // {BLOCK}
              ELSE (passes - 1) * blocks + (start + size - 1) // {BLOCK} END AS last_rank
  FROM q)
SELECT e.doc_id, e.size, e.words AS source_size, e.target, e.taken,
       f.slot::BIGINT AS first_slot, l.slot::BIGINT AS last_slot
FROM e LEFT JOIN o f ON e.taken > 0 AND f.sid = e.sid AND f.rank = e.first_rank
       LEFT JOIN o l ON e.taken > 0 AND l.sid = e.sid AND l.rank = e.last_rank
"""
