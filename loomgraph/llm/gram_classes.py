"""Occurrences and records of the n-grams of every length, from suffixes refined by doubled lengths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.workspace import Workspace

#: Words of one block, about; bounds a task's memory.  A longer text is a block of its own.
BLOCK = 1 << 17
#: A place is its block's number and its position there.
PLACE_BITS = 31
BLOCKS_BITS = 16


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def own_prefixes(tokens: np.ndarray, record: np.ndarray) -> np.ndarray:
    """For each position, the tokens its suffix shares with the one before it among its record's ordered suffixes.

    Of the places of an n-gram in a record, all but one have n or more; so its
    records are its places with fewer than n.  Suffixes are ordered by prefix
    doubling; the common prefixes are read off the ranks of the doubled lengths.
    """
    n = len(tokens)
    rank = np.unique(record * (int(tokens.max()) + 1) + tokens, return_inverse=True)[1].astype(np.int64)
    ladder, k = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(s[1:] != s[:-1])]
        ladder.append(rank.astype(np.int32))
        k *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(ladder) - 1, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        inside = (x < n) & (y < n)
        same = inside & (ladder[j][np.minimum(x, n - 1)] == ladder[j][np.minimum(y, n - 1)])
        shared[1:] += same.astype(np.int64) << j
    out = np.empty(n, np.int64)
    out[order] = shared
    return out


def _room(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its text, which is its record's end or a null (-1)."""
    stop = np.repeat(np.cumsum(sizes), sizes)
    stop = np.where(ids < 0, np.arange(len(ids)), stop)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))


_BLOCKS = "block bigint, records array<bigint>, sizes array<int>, ids array<int>, words array<bigint>"
_PLACES = "place bigint, own int, word bigint"


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Records in order, in blocks of about ``limit`` words: their sizes and their words, coded."""
    number = TaskContext.get().partitionId() << BLOCKS_BITS
    held, words = [], 0

    def block():
        nonlocal number
        number += 1
        t = pa.Table.from_batches(held).combine_chunks()
        coded = pa.concat_arrays([b.column(1).flatten() for b in held]).dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(t.column(1)), 0).cast(pa.int32())
        one = [
            [number - 1],
            [t.column(0).to_pylist()],
            [sizes.to_pylist()],
            [pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)],
            [coded.dictionary.to_numpy(zero_copy_only=False)],
        ]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(one, types)], ["block", "records", "sizes", "ids", "words"])

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for k, size in enumerate(sizes):
            if words and words + size > limit:
                if k > first:
                    held.append(batch.slice(first, k - first))
                yield block()
                held, words, first = [], 0, k
            words += int(size)
        held.append(batch.slice(first))
    if words:
        yield block()


def _read(batch, k: int):
    """A block's number, records, sizes, coded words, hashes of the words and room at each position."""
    number, records, sizes, ids, words = (batch.column(c)[k] for c in ("block", "records", "sizes", "ids", "words"))
    sizes, ids = (x.values.to_numpy(zero_copy_only=False) for x in (sizes, ids))
    hashes = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return number.as_py(), records.values, sizes, ids, hashes, _room(ids, sizes)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place of a word, with what its suffix shares with another one of the record."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, _, sizes, ids, hashes, room = _read(batch, k)
            at = np.flatnonzero(room > 0)
            if not len(at):
                continue
            # a null is equal to nothing
            codes = np.where(ids < 0, len(hashes) + np.arange(len(ids)), ids).astype(np.int64)
            own = own_prefixes(codes, np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array((number << PLACE_BITS) + at), pa.array(own[at].astype(np.int32)), pa.array(hashes[ids[at]].view(np.int64))],
                ["place", "own", "word"],
            )


def _with(rows: DataFrame, blocks: DataFrame, place: str, added: str, find) -> DataFrame:
    """Columns ``added`` that ``find(rows, positions, block)`` reads off the block of each row's place."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _read(right.combine_chunks().to_batches()[0], 0) if left.num_rows else None
        left = left.drop_columns(["block"])
        if block is None:
            empty = pa.schema([(n, t) for n, t in types])
            return pa.Table.from_batches([], pa.schema([*left.schema, *empty]))
        at = left.column(place).to_numpy() & ((1 << PLACE_BITS) - 1)
        for (name, _), values in zip(types, find(left, at, block)):
            left = left.append_column(name, values)
        return left

    types = [(c.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in added.split(", ")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [added])
    keyed = rows.withColumn("block", F.shiftright(place, PLACE_BITS))
    return keyed.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(add, schema)


def _next_words(rows: pa.Table, at: np.ndarray, block) -> list[pa.Array]:
    """A hash of the ``step`` words, a power of 2, that follow a place's first ``a``; null where its text ends before."""
    _, _, _, ids, hashes, room = block
    a, step = (rows.column(c).to_numpy().astype(np.int64) for c in ("a", "step"))
    out = np.zeros(len(at), np.uint64)
    there = room[at] >= a + step
    ladder, k = hashes[ids], 1  # nulls have any word's: no room reaches over them
    top = int(step[there].max()) if there.any() else 0
    while k <= top:
        now = there & (step == k)
        out[now] = ladder[at[now] + a[now]]
        longer = np.zeros_like(ladder)
        longer[: max(0, len(ladder) - k)] = _mix(ladder[: max(0, len(ladder) - k)], ladder[k:])
        ladder, k = longer, 2 * k
    return [pa.array(out.view(np.int64), mask=~there)]


def _whereabouts(rows: pa.Table, at: np.ndarray, block) -> list[pa.Array]:
    """A place's record, its 1-based word there, and the words to the text's end."""
    _, records, sizes, _, _, room = block
    ends = np.cumsum(sizes)
    k = np.searchsorted(ends, at, "right")
    return [records.take(pa.array(k)), pa.array((at - (ends - sizes)[k] + 1).astype(np.int32)), pa.array(room[at].astype(np.int32))]


def ngram_classes(df: DataFrame, record: str, tokens: str) -> DataFrame:
    """``(record, word, n_from, n_to, occurrences, records)``: the n-grams of every length, without limit.

    ``tokens`` is ARRAY<STRING>, one row a record; ``record`` is a BIGINT that
    is null in no row and in no two the same.  A null token ends the text there.

    n-grams of all lengths are too many to be listed, but the ones with the
    same places are as one: if an n-gram goes on with the same word wherever it
    stands, the longer one has its counts.  A row is such a class: the n-grams of
    ``n_from`` to ``n_to`` words that begin at the ``word``-th word (from 1) of
    ``record``, the first place, by record and position, where they stand.  Every distinct
    n-gram is in exactly one row, and there are at most two rows a word.

    Places are grouped by their first word, then by 2, 4, 8, ... words, as long
    as a group has two.  A group whose places do not all stay together up to
    twice the words is taken apart at half the way, then quarters, and so on,
    until the lengths are known at which it divides.  There each part is one row with its
    number of places, not the places, and how many of them are the first of their
    record is known from ``own_prefixes``, so that nothing is counted by group and
    record.  Groups are named by their first place, and parts of one group are told apart by
    64-bit hashes of their words.  A round reads the words in blocks and sends rows to them; no
    group is gathered in one task.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "gram-classes")
    coded = df.select(
        F.col(record).cast("bigint").alias("record"),
        F.transform(F.col(tokens), lambda x: F.when(x.isNotNull(), F.xxhash64(x))).alias("t"),
    ).where(F.size("t") > 0)
    ordered = coded.repartitionByRange("record").sortWithinPartitions("record")
    limit = BLOCK
    blocks = ws.save(ordered.mapInArrow(lambda batches: _blocks(batches, limit), _BLOCKS), "blocks")
    places = ws.save(blocks.mapInArrow(_places, _PLACES), "places")

    words = places.groupBy("word").agg(
        F.min("place").alias("group"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") < 1).alias("records")
    )
    words, left = ws.save_counted(words, "words", F.col("n") > 1)
    starts = [words.select("group", F.lit(1).alias("n_from"), "n", "records")]
    stops: list[DataFrame] = []
    members, old = places.join(words.where("n > 1"), "word").select("place", "own", "group", "n"), places

    # 1, 2, 4, ... words: the groups that do not stay together
    size, divided = 1, []
    while left:
        asked = members.withColumns({"a": F.lit(size), "step": F.lit(size)})
        seen = ws.save(_with(asked, blocks, "place", "h bigint", _next_words), "seen")
        parts = seen.where("h IS NOT NULL").groupBy("group", "h").agg(F.min("place").alias("part"), F.count(F.lit(1)).alias("part_n"))
        told = seen.join(parts, ["group", "h"], "left").select(
            "a", "step", "group", "n", "place", "own",
            F.coalesce("part", "place").alias("part"), F.coalesce("part_n", F.lit(1)).alias("part_n"), F.col("h").isNull().alias("over"),
        )
        told, left = ws.save_counted(told, "told", F.col("part_n") > 1)
        ws.drop(old, seen)
        own = F.greatest(F.col("a") - 1, F.least(F.col("a") + F.col("step"), "own")).alias("own")
        divided.append(
            ws.save(
                told.where("part_n < n").groupBy("a", "step", "group", "n", "part", "part_n", "over", own).agg(F.count(F.lit(1)).alias("places")),
                "divided",
            )
        )
        members = told.where("part_n > 1").select("place", "own", F.col("part").alias("group"), F.col("part_n").alias("n"))
        old, size = told, 2 * size
    ws.drop(old)

    # between the lengths a and a + step: at half the way, until the step is a word
    known = reduce(DataFrame.unionByName, divided) if divided else None
    while known is not None:
        found = known.where("step = 1")
        stops.append(found.select("group", F.col("a").alias("n_to"), "n").distinct())
        starts.append(
            found.where("NOT over").groupBy(F.col("part").alias("group"), (F.col("a") + 1).alias("n_from"), F.col("part_n").alias("n"))
            .agg(F.sum(F.when(F.col("own") <= F.col("a"), F.col("places")).otherwise(0)).alias("records"))
        )
        halved = known.where("step > 1").withColumn("step", (F.col("step") / 2).cast("int"))
        seen, left = ws.save_counted(_with(halved, blocks, "part", "h bigint", _next_words), "seen")
        if not left:
            break
        key = ["group", "a", "h"]
        halves = seen.where("h IS NOT NULL").groupBy(*key).agg(F.min("part").alias("half"), F.sum("places").alias("half_n"))
        middle = F.col("a") + F.col("step")
        upper = F.struct(
            middle.alias("a"), F.col("half").alias("group"), F.col("half_n").alias("n"), "part", "part_n", "over",
            F.greatest(middle - 1, "own").alias("own"),
        )
        lower = F.struct(
            "a", "group", "n", F.coalesce("half", "part").alias("part"), F.coalesce("half_n", "part_n").alias("part_n"),
            F.col("h").isNull().alias("over"), F.least(middle, "own").alias("own"),
        )
        both = F.array(F.when(F.expr("part_n < half_n"), upper), F.when(F.expr("h IS NULL OR half_n < n"), lower))
        told = seen.join(halves, key, "left").select("step", "places", F.explode(F.array_compact(both)).alias("x"))
        known = ws.save(told.groupBy("step", "x").agg(F.sum("places").alias("places")).select("step", "x.*", "places"), "divided")
        ws.drop(seen)

    rows = reduce(DataFrame.unionByName, starts)
    if stops:
        rows = rows.join(reduce(DataFrame.unionByName, stops), ["group", "n"], "left")
    else:
        rows = rows.withColumn("n_to", F.lit(None).cast("int"))
    return _with(rows, blocks, "group", "record bigint, word int, room int", _whereabouts).select(
        "record", "word", "n_from", F.coalesce("n_to", "room").alias("n_to"), F.col("n").alias("occurrences"), "records"
    )
