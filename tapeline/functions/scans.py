"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Each scan here
cuts a key into time chunks, works inside the chunks in parallel, reduces every
chunk to a small summary, carries the summaries along the key and finishes inside
the chunks again. Chunks are cut by value, never by partition number, so a lost
executor recomputes the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeline.functions.expr import order_key

CHUNK_WINDOWS = 24  # cooldown windows per chunk


def complete_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut a key-sorted batch stream so that no key group spans two frames."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[keys].iloc[-1]
        tail = np.ones(len(batch), dtype=bool)
        for k in keys:
            tail &= (batch[k] == last[k]).to_numpy()
        if tail.all() and (not held or _same(held[-1], batch, keys)):
            held.append(batch)
            continue
        cut = int(np.argmax(tail))
        if tail.all():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
            continue
        yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
        held = [batch.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _same(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(a[k].iloc[-1] == b[k].iloc[0] for k in keys)


def group_ids(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Running group number over key-sorted rows."""
    change = np.zeros(len(frame), dtype=np.int64)
    for k in keys:
        values = frame[k].to_numpy()
        change[1:] |= (values[1:] != values[:-1]).astype(np.int64)
    return np.cumsum(change)


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key. Spark cuts each key to one row per task before the shuffle."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ordered)).filter("_rn = 1").drop("_rn")


def row_number_by_chunk(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], out: str,
    chunk_desc: bool = False,
) -> DataFrame:
    """``row_number`` over ``keys`` whose order starts with ``chunk``.

    Rows are numbered inside (keys, chunk); the per-chunk counts, one row per
    chunk, are summed along the key and added as an offset.
    """
    chunked = df.withColumn("_chunk", chunk)
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    chunk_order = F.col("_chunk").desc() if chunk_desc else F.col("_chunk").asc()
    along = Window.partitionBy(*keys).orderBy(chunk_order)
    offsets = counts.select(
        *keys, "_chunk",
        F.coalesce(
            F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_rn", "_offset", "_chunk")
    )


def previous_non_null(
    df: DataFrame, key: str, seconds: str, tie: str, cols: list[str], prefix: str = "prev_",
    chunk_seconds: int = 60,
) -> DataFrame:
    """Last non-null value of each column strictly before the row, per key.

    Rows are ordered by (seconds, tie); ``tie`` is a bigint that makes it total.
    """
    chunked = df.withColumn(
        "_chunk", F.floor(F.col(seconds) / F.lit(chunk_seconds)).cast("bigint")
    ).repartition(key, "_chunk")
    before = (
        Window.partitionBy(key, "_chunk").orderBy(seconds, tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = chunked.select(
        "*", *[F.last(c, ignorenulls=True).over(before).alias(prefix + c) for c in cols]
    )
    position = order_key(F.col(seconds), F.col(tie))
    tails = chunked.groupBy(key, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in cols]
    )
    along = (
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        key, "_chunk", *[F.last(c, ignorenulls=True).over(along).alias("_in_" + c) for c in cols]
    )
    joined = inside.join(carried, [key, "_chunk"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(prefix + c, "_in_" + c).alias(prefix + c) for c in cols],
    )


# --- greedy cooldown -------------------------------------------------------


def _next_allowed(frame: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, ...]:
    """For each candidate, the row of the first one at least a window later, or -1."""
    gid = group_ids(frame, keys)
    ts = frame["ts_s"].to_numpy(dtype=np.int64)
    window = frame["window_s"].to_numpy(dtype=np.int64)
    base = int(ts.min())
    span = int(ts.max()) - base + int(window.max()) + 1
    place = gid * span + (ts - base)
    nxt = np.searchsorted(place, place + window, side="left")
    inside = nxt < len(ts)
    inside[inside] = gid[nxt[inside]] == gid[inside]
    return gid, ts, window, place, np.where(inside, nxt, -1), base, span


def _chunk_steps(keys: list[str], any_carry: bool) -> Callable:
    """Each chunk as a step function: carried-in last fire -> last fire at chunk end.

    ``any_carry`` allows a carried-in fire inside or after the chunk, which late rows
    can meet.
    """
    group = [*keys, "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, group):
            gid, ts, window, _, nxt, _, _ = _next_allowed(frame, group)
            hop = np.where(nxt >= 0, nxt, np.arange(len(ts)))
            while True:
                further = hop[hop]
                if np.array_equal(further, hop):
                    break
                hop = further
            exits = ts[hop]
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            rows = []
            first_window = (frame["chunk"].to_numpy(dtype=np.int64) * CHUNK_WINDOWS + 1) * window
            for s, e in zip(starts, np.r_[starts[1:], len(ts)]):
                # A carried-in fire is before the chunk, so the first fire inside is one
                # of the candidates of the first window or the first one after it.
                reach = e if any_carry else min(
                    e, s + np.searchsorted(ts[s:e], first_window[s], side="left") + 1
                )
                entry, out = ts[s:reach], exits[s:reach]
                keep = np.r_[out[1:] != out[:-1], True]
                rows.append((entry[keep], out[keep]))
            head = frame.iloc[starts][[*group, "window_s"]].reset_index(drop=True)
            yield head.assign(entries=[r[0] for r in rows], exits=[r[1] for r in rows])

    return run


def _carry_along(keys: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for frame in batches:
            carried = []
            columns = [frame[k] for k in keys]
            for i, (window, entries, exits, first) in enumerate(
                zip(frame["window_s"], frame["entries"], frame["exits"], frame["carry_s"])
            ):
                key = tuple(c.iat[i] for c in columns)
                if key != current:
                    current, last = key, None if pd.isna(first) else int(first)
                carried.append(last)
                at = 0 if last is None else bisect_left(entries, last + window)
                if at < len(entries):
                    last = int(exits[at])
            yield frame[[*keys, "chunk"]].assign(
                carry_s=pd.array(carried, dtype="Int64")
            )

    return run


def _mark_fires(keys: list[str]) -> Callable:
    group = [*keys, "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, group):
            gid, ts, window, place, nxt, base, span = _next_allowed(frame, group)
            starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
            carry = frame["carry_s"].iloc[starts].to_numpy(dtype="float64", na_value=np.nan)
            earliest = np.where(np.isnan(carry), 0, carry + window[starts] - base)
            earliest = np.clip(earliest, 0, span - 1).astype(np.int64)
            at = np.searchsorted(place, gid[starts] * span + earliest, side="left")
            valid = at < len(ts)
            valid[valid] = gid[at[valid]] == gid[starts][valid]
            at = at[valid]
            fired = np.zeros(len(ts), dtype=bool)
            while len(at):
                fired[at] = True
                at = nxt[at]
                at = at[at >= 0]
            yield frame.loc[fired, [*keys, "ts_s"]]

    return run


def greedy_cooldown(
    candidates: DataFrame, keys: list[str], carry: DataFrame | None = None
) -> DataFrame:
    """Which candidate seconds fire when a fire silences its key for ``window_s``.

    ``candidates`` holds ``keys``, ``ts_s`` and ``window_s`` (> 0, constant per key)
    with one row per key and second, so a chunk of 24 windows is bounded by the
    clock and not by the number of alerts. Exactly one window later fires again.
    ``carry`` optionally holds (keys, carry_s), the last fire before these rows.
    Returns (keys, ts_s) of the fires.
    """
    typed = {f.name: f.dataType for f in candidates.schema.fields}
    key_fields = [T.StructField(k, typed[k]) for k in keys]
    chunk_field = T.StructField("chunk", T.LongType())
    longs = T.ArrayType(T.LongType())

    cut = candidates.select(
        *keys,
        F.col("ts_s").cast("bigint").alias("ts_s"),
        F.col("window_s").cast("bigint").alias("window_s"),
        F.floor(F.col("ts_s") / (F.col("window_s") * CHUNK_WINDOWS)).cast("bigint").alias("chunk"),
    ).repartition(*keys, "chunk")

    steps = cut.sortWithinPartitions(*keys, "chunk", "ts_s").mapInPandas(
        _chunk_steps(keys, carry is not None),
        T.StructType([*key_fields, chunk_field, T.StructField("window_s", T.LongType()),
                      T.StructField("entries", longs), T.StructField("exits", longs)]),
    )
    if carry is None:
        steps = steps.withColumn("carry_s", F.lit(None).cast("bigint"))
    else:
        steps = steps.join(carry.select(*keys, F.col("carry_s").cast("bigint")), keys, "left")
    carried = (
        steps.repartition(*keys)
        .sortWithinPartitions(*keys, "chunk")
        .mapInPandas(
            _carry_along(keys),
            T.StructType([*key_fields, chunk_field, T.StructField("carry_s", T.LongType())]),
        )
    )
    return (
        cut.join(carried, [*keys, "chunk"])
        .sortWithinPartitions(*keys, "chunk", "ts_s")
        .mapInPandas(
            _mark_fires(keys), T.StructType([*key_fields, T.StructField("ts_s", T.LongType())])
        )
    )


# --- newest distinct items as of a moment ------------------------------------

DAY_S = 86_400
PROBE = "~"  # marks a probe in the stream of items


def _newest_per_key(df: DataFrame, scope: list[str], k: int) -> DataFrame:
    """Newest row per item key inside ``scope``, then the k newest of those.

    ``row_number() <= k`` lets Spark cut every scope to k rows before the shuffle.
    """
    order = [F.col("at_us").desc(), *(["payload"] if "payload" in df.columns else [])]
    newest = Window.partitionBy(*scope).orderBy(F.col("at_us").desc(), F.col("item_key"))
    return (
        first_row(df, [*scope, "item_key"], order)
        .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k).drop("_r")
    )


def _latest_items(k: int, scope: list[str], ttl_s: dict[str, int]) -> Callable:
    """One ordered pass over items and probes; the state is the k newest items per side."""
    group = [*scope, "day"]
    reach_us = {side: ttl * 1_000_000 for side, ttl in ttl_s.items()}

    def answer(recent: dict, now_us: int) -> list[tuple]:
        """Newest k of all sides, one per key; the alphabetically first side wins a tie."""
        known = [
            (-us, key, side)
            for side, items in recent.items()
            for key, us in items.items()
            if us >= now_us - reach_us[side]
        ]
        best: dict[str, tuple] = {}
        for us, key, side in sorted(known, key=lambda r: (r[0], r[2])):
            best.setdefault(key, (us, key, side))
        return sorted(best.values())[:k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, {}
        for frame in batches:
            group_cols = [frame[c].to_numpy() for c in group]
            probe_row, ranks, found = [], [], []
            for i, (at_s, side, key, at_us) in enumerate(
                zip(frame["at_s"], frame["side"], frame["item_key"], frame["at_us"])
            ):
                here = tuple(c[i] for c in group_cols)
                if here != current:
                    current, recent = here, {s: {} for s in ttl_s}
                if side in reach_us:
                    items = recent[side]
                    items.pop(key, None)
                    items[key] = at_us
                    if len(items) > k:
                        del items[next(iter(items))]
                    continue
                for rank, item in enumerate(answer(recent, at_s * 1_000_000), 1):
                    probe_row.append(i)
                    ranks.append(rank)
                    found.append(item)
            out = frame.iloc[probe_row][[*scope, "at_s"]].reset_index(drop=True)
            yield out.assign(
                rank=pd.Series(ranks, dtype="int32"),
                at_us=pd.Series([-f[0] for f in found], dtype="int64"),
                item_key=pd.Series([f[1] for f in found], dtype="object"),
                side=pd.Series([f[2] for f in found], dtype="object"),
            )

    return run


def newest_items_as_of(
    probes: DataFrame, items: DataFrame, scope: list[str], k: int, ttl_s: dict[str, int]
) -> DataFrame:
    """For each probe, the k newest items with distinct keys that are still fresh enough.

    ``probes``: scope, at_s. ``items``: scope, side, item_key, at_us, payload; ``ttl_s``
    says how long items of each side count. Of one key the newest version is taken.

    No probe/item pair is formed outside the answer. Items shrink to k per side and
    second and to k per side and day; a probe's day starts from the k newest of the
    days before it and is then one streaming pass, bounded by the clock whatever the
    size of the scope, that holds k items per side in memory. Payloads stay out of the
    pass and are joined to its answers.
    """
    days_back = -(-max(ttl_s.values()) // DAY_S)

    def day_of(second: str) -> Column:
        return F.floor(F.col(second) / DAY_S).cast("bigint")

    sided = [*scope, "side"]
    seconds = _newest_per_key(
        items.select(
            *sided, "item_key", "at_us", "payload",
            F.ceil(F.col("at_us") / 1_000_000).cast("bigint").alias("at_s"),
        ),
        [*sided, "at_s"], k,
    )
    narrow = seconds.select(*sided, "at_s", "item_key", "at_us").withColumn("day", day_of("at_s"))
    days = _newest_per_key(narrow, [*sided, "day"], k)
    # A day's newest items are handed to the following days within reach.
    later = days.withColumn(
        "day", F.explode(F.sequence(F.col("day") + 1, F.col("day") + days_back))
    )
    carried = _newest_per_key(later, [*sided, "day"], k)
    asked = probes.select(*scope, F.col("at_s").cast("bigint").alias("at_s")).distinct()

    columns = [*scope, "day", "at_s", "side", "item_key", "at_us"]
    as_probes = asked.withColumns({
        "day": day_of("at_s"), "side": F.lit(PROBE), "item_key": F.lit(""),
        "at_us": F.lit(0).cast("bigint"),
    })
    stream = (
        carried.select(*columns).unionByName(narrow.select(*columns))
        .unionByName(as_probes.select(*columns))
    )
    typed = {f.name: f.dataType for f in probes.schema.fields}
    answers = (
        stream.repartition(*scope, "day")
        # Items of a probe's own second come before the probe.
        .sortWithinPartitions(
            *scope, "day", "at_s", F.col("side") == PROBE, "at_us", F.col("item_key").desc()
        )
        .mapInPandas(
            _latest_items(k, scope, ttl_s),
            T.StructType([
                *[T.StructField(c, typed[c]) for c in scope],
                T.StructField("at_s", T.LongType()),
                T.StructField("rank", T.IntegerType()),
                T.StructField("at_us", T.LongType()),
                T.StructField("item_key", T.StringType()),
                T.StructField("side", T.StringType()),
            ]),
        )
    )
    return answers.join(seconds.drop("at_s"), [*sided, "item_key", "at_us"])
