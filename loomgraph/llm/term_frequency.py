"""Occurrences and record counts of every n-gram, from suffix arrays with LCP intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of one in-memory suffix array; a block bounds a task's memory.
BLOCK = 1 << 20


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first ``depth`` tokens of their suffix, then by position.

    Prefix doubling over dense ranks: ``ceil(log2(depth))`` stable sorts.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n:
        step = min(k, depth - k)
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, k + step
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each position of the suffix array, the tokens shared with the suffix before it, at most ``depth``."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    live = np.arange(1, n)
    for d in range(depth):
        a, b = order[live - 1] + d, order[live] + d
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[tokens[a] == tokens[b]]
        if not len(live):
            break
        lcp[live] = d + 1
    return lcp


def intervals(tokens: np.ndarray, record: np.ndarray, room: np.ndarray, max_n: int):
    """``(n, positions, starts, repeated)`` for each length of n-grams, up to ``max_n``.

    ``tokens`` holds texts one after another, a record's texts together;
    ``room`` is the number of tokens from a position to its text's end.  An
    n-gram is an interval of the suffix array whose inner common prefixes are at
    least n; ``starts`` marks the first of its ``positions``.  Ties are ordered
    by position, so the entries of a record lie next to each other: those after
    the first are ``repeated``.
    """
    order = suffix_array(tokens, max_n)
    lcp = common_prefixes(tokens, order, max_n)
    for n in range(1, max_n + 1):
        fits = room[order] >= n
        if not fits.any():
            return
        group = np.cumsum(lcp < n)[fits]
        o = order[fits]
        if n < max_n:  # what follows the n tokens has ordered them; put each interval back by position
            o = o[np.lexsort((o, group))]
        start = np.r_[True, group[1:] != group[:-1]]
        yield n, o, start, np.r_[False, record[o][1:] == record[o][:-1]] & ~start


def gram_intervals(tokens: np.ndarray, record: np.ndarray, room: np.ndarray, max_n: int):
    """``(n, first position, occurrences, records)`` of every distinct n-gram, one entry a length:
    an interval's length, and that less its repeated entries."""
    out = []
    for n, o, start, same in intervals(tokens, record, room, max_n):
        at = np.flatnonzero(start)
        size = np.diff(np.r_[at, len(o)])
        out.append((n, o[at], size, size - np.add.reduceat(same.astype(np.int64), at)))
    return out


def _value_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: each (value, record) pair once with its occurrences.

    The block's rows, ordered by record, are texts of one token each; in a
    value's interval the repeated entries of a record are merged into one.
    """
    for val, rec in _gather(batches, ("val", "rec")):
        by = np.argsort(rec, kind="stable")
        val, rec = val[by], rec[by]
        for _, o, _, same in intervals(val, rec, np.ones(len(val), np.int64), 1):
            at = np.flatnonzero(~same)
            yield pa.RecordBatch.from_arrays(
                [pa.array(val[o[at]]), pa.array(rec[o[at]]), pa.array(np.diff(np.r_[at, len(o)]))], ["val", "rec", "n"]
            )


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a sorted partition: occurrences and records of each value's interval.

    The last pair is remembered, so that a pair cut by a block's end counts once.
    """
    last = None
    for val, rec, n in _gather(batches, ("val", "rec", "n")):
        for _, o, start, same in intervals(val, rec, np.ones(len(val), np.int64), 1):
            same[0] |= (val[o[0]], rec[o[0]]) == last
            last = (val[o[-1]], rec[o[-1]])
            at = np.flatnonzero(start)
            size = np.diff(np.r_[at, len(o)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(val[o[at]]),
                    pa.array(np.add.reduceat(n[o], at)),
                    pa.array(size - np.add.reduceat(same.astype(np.int64), at)),
                ],
                ["val", "n", "records"],
            )


def _gather(batches, names):
    """Arrow batches joined to blocks of about ``BLOCK`` rows, as arrays."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK:
            yield _columns(held, names)
            held, rows = [], 0
    if rows:
        yield _columns(held, names)


def _columns(held, names):
    t = pa.Table.from_batches(held)
    return tuple(t.column(c).to_numpy() for c in names)


def value_frequencies(df: DataFrame, value: str, record: str) -> DataFrame:
    """``(val, occurrences, records)`` of every distinct non-null BIGINT value.

    ``records`` is the number of distinct non-null ``record`` ids (BIGINT) the
    value occurs with; a row with a null record is an occurrence but in no
    record.  Repeated rows are occurrences, not records.  An empty table gives
    no rows.  Only the two columns are read, so clashing names do not matter.

    A value is the n-gram of one token.  Suffix arrays of bounded blocks merge
    the duplicate adjacencies of a record on the map side.  The compact pairs
    are shuffled by value *and* record, so neither a value nor a record with a
    third of all rows makes a large partition, and all duplicates of a pair
    meet.  Sorted partitions are merged the same way, block by block, and what
    is left, one row a value and partition, is summed.
    """
    rows = df.select(
        F.col(value).cast("bigint").alias("val"), F.col(record).cast("bigint").alias("rec")
    ).where(F.col("val").isNotNull())
    with_record = rows.where(F.col("rec").isNotNull())
    pairs = with_record.mapInArrow(_value_blocks, "val bigint, rec bigint, n bigint")
    merged = (
        pairs.repartition(F.col("val"), F.col("rec"))
        .sortWithinPartitions("val", "rec")
        .mapInArrow(_merge_blocks, "val bigint, n bigint, records bigint")
    )
    loose = (
        rows.where(F.col("rec").isNull())
        .groupBy("val")
        .agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("records"))
    )
    return (
        merged.unionByName(loose)
        .groupBy("val")
        .agg(F.sum("n").alias("occurrences"), F.sum("records").alias("records"))
    )


def words(text):
    """The words of a text column in lower case: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _gram_blocks(column: pa.Array, max_n: int) -> Iterator[pa.RecordBatch]:
    """The grams of arrays of words, records cut to blocks of about ``BLOCK`` words."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        flat = column.slice(first, end - first).flatten()
        record = np.repeat(np.arange(end - first), sizes[first:end])
        first = end
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        ids = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        # a text ends at its record's end and at a null
        stop = np.where(np.r_[record[1:] != record[:-1], True], np.arange(1, len(ids) + 1), len(ids))
        stop = np.where(ids < 0, np.arange(len(ids)), stop)
        room = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))
        for n, at, occurrences, records in gram_intervals(ids, record, room, max_n):
            parts = [coded.dictionary.take(pa.array(ids[at + k])) for k in range(n)]
            gram = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            columns = [gram.cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(occurrences), pa.array(records)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "n", "occurrences", "records"])


def ngram_frequencies(df: DataFrame, tokens: str, max_n: int) -> DataFrame:
    """``(gram, n, occurrences, records)`` of all n-grams, 1 to ``max_n``, of token arrays.

    ``tokens`` is ARRAY<STRING>, one row a record; a null array or token ends
    the text there.  A gram is its tokens with blanks between, so tokens should
    have none.  Each block's suffix array gives exact counts of its records
    and, as a record lies in one block, the blocks' counts add up: what is
    shuffled is each gram of a block once.
    """

    def blocks(batches):
        for batch in batches:
            yield from _gram_blocks(batch.column(0), max_n)

    part = df.select(F.col(tokens).alias("t")).mapInArrow(blocks, "gram string, n int, occurrences bigint, records bigint")
    return part.groupBy("gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
