"""Operator 4, substring dedup: suffix trees of groups of suffixes, partitioned by prefixes of varying length.

A suffix counts by its first ``span`` words (a window). So that a suffix needn't be sent anywhere alone, it is filed under its anchor: the run of ``gram`` words in the window with
the least hash. Suffixes with one anchor lie side by side in a text and travel together, as a segment of words. A group is the suffixes of all segments of one anchor. Prefixes are
lengthened as needed: at ``gram`` words plus half of the rest of the window, to the left or right of the anchor, a prefix that only one text has is a leaf, and its suffixes
are dropped unread; a group of over ``GROUP_ROWS`` segments is parted by prefixes of all ``span`` words, each of them a group of its own (told by 128 bits of hash), summed up
by its least document before the shuffle. The other groups are small; each is read by one task, which sorts its suffixes by their words (prefix doubling), takes
longest common prefixes from neighbours, and reads off the internal nodes of depth ``span`` and more: the suffixes under one of them are one repeat. Its least
document keeps it.

Equal texts are taken as one: the document with the least id stands for all, so copies are never compared.

Defined results: a null text has no words; a document under ``span`` words loses none; a document whose text a smaller id has loses every word if it has ``span`` or more; rows with
one doc_id are never smaller than each other, and each gives a row; a null doc_id counts as the largest; an empty table gives an empty result; texts of any length are read
whole; bytes that aren't UTF-8 are parts of words; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import join_by_class, materialize

SPAN = 50
GRAM = 10
#: Segments of a group that one task may hold; a larger group is parted by its whole windows.
GROUP_ROWS = 50_000
#: Bytes of segments whose suffixes are sorted at once.
TREE_BYTES = 1 << 22
_LAST = (1 << 63) - 1
_B1, _B2, _B3 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9  # odd, so they have inverses modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: White space parts words; every other byte is a letter.
LETTERS = np.array([0 if c == 32 or 9 <= c <= 13 else c + 1 for c in range(256)], np.uint16)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of ``base`` and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            np.multiply.accumulate(np.full(size - 1, x, np.uint64), out=p[1:])
            both.append(p)
        _POWERS[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def run_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on; ``words``: hashes of the words."""
    n = len(words)
    if n < length:
        return np.empty(0, np.int64)
    power, inverse = _powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.view(np.uint64) * inverse[:n], out=total[1:])
    return _words.mix((total[length:] - total[:-length]) * power[: n - length + 1]).view(np.int64)


class Anchored:
    """The suffixes of some texts, filed under their anchors.

    ``text``, ``place``: of each anchor, the text and the flat place of its first word; ``lo``, ``hi``: its suffixes begin at the flat places from ``lo`` to before ``hi``;
    ``gram``: hash of the anchor; ``left``, ``right``: hashes of the longer prefixes, for the suffixes that begin far and near before the anchor (with ``has_left``, ``has_right``).
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, span: int, gram: int):
        """``words``: hashes; ``ends``: where each text's words begin, and the last one's end."""
        self.half = (span - gram) // 2
        n = len(words)
        counts = np.diff(ends)
        text = np.repeat(np.arange(len(counts)), counts)
        grams = run_hashes(words, gram, _B1)
        if n < span:
            starts = at = np.empty(0, np.int64)
        else:
            at = np.lib.stride_tricks.sliding_window_view(grams, span - gram + 1).argmin(1) + np.arange(n - span + 1)
            starts = np.flatnonzero(np.arange(n - span + 1) + span <= ends[text[: n - span + 1] + 1])
            at = at[starts]
        new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(at) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.place = at[first]
        self.lo = starts[first]
        self.hi = starts[np.r_[first[1:] - 1, len(at) - 1]] + 1 if len(at) else starts
        self.text = text[self.place]
        self.gram = grams[self.place]
        self.has_left = self.lo <= self.place - self.half
        self.has_right = self.hi - 1 > self.place - self.half
        longer = run_hashes(words, gram + self.half, _B2)
        self.left = np.zeros(len(first), np.int64)
        self.right = np.zeros(len(first), np.int64)
        self.left[self.has_left] = longer[self.place[self.has_left] - self.half]
        self.right[self.has_right] = ~longer[self.place[self.has_right]]


def _in_slices(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last, hashes of words, where each text's words begin)."""
    for i, j in _words.slices(ends, 1 << 19):
        h, counts = _words.hashes(data, ends[i : j + 1], LETTERS)
        yield i, j, h, np.concatenate([[0], np.cumsum(counts)])


def _first_pass(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, ends = _words.bytes_of(batch.column(2))
            for i, j, words, at in _in_slices(data, ends):
                a = Anchored(words, at, span, gram)
                text = np.r_[a.text[a.has_left], a.text[a.has_right]]
                key = np.r_[a.left[a.has_left], a.right[a.has_right]]
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                once = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])] if len(text) else np.empty(0, bool)
                text, key = text[once], key[once]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))]).astype(np.int32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), *part.columns, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key))],
                    names=["row", "doc_id", "th", "text", "n_words", "keys"],
                )
                row += j - i

    return run


def _segments(span: int, gram: int):
    """Rows (gram, doc_key, row, at, n, segment): the words of the ``n`` suffixes that begin from the word ``at`` on and share an anchor, for the prefixes listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _words.bytes_of(batch.column(2))
            wanted = batch.column(3)
            for i, j, words, at in _in_slices(data, ends):
                a = Anchored(words, at, span, gram)
                # suffixes of an anchor that a repeated prefix leads to: far before it (left), near before it (right), or both
                list_at = np.asarray(wanted.offsets)[i : j + 1]
                keys = np.asarray(wanted.values)[list_at[0] : list_at[-1]]
                owner = np.repeat(np.arange(j - i), np.diff(list_at))
                have = np.sort(_words.mix(keys.view(np.uint64) + owner.astype(np.uint64) * np.uint64(_B3)))
                found = lambda key: np.isin(_words.mix(key.view(np.uint64) + a.text.astype(np.uint64) * np.uint64(_B3)), have)
                left, right = a.has_left & found(a.left), a.has_right & found(a.right)
                middle = a.place - a.half
                lo = np.where(left, a.lo, np.maximum(a.lo, middle + 1))
                hi = np.where(right, a.hi, np.minimum(a.hi, middle + 1))
                use = np.flatnonzero((left | right) & (lo < hi))
                begin, end, _ = _words.word_spans(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], LETTERS)
                b, e = begin[lo[use]] + ends[i], end[hi[use] + span - 2] + ends[i]
                text = a.text[use]
                keys_of, rows_of = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                raw = data.tobytes() if len(use) else b""
                cols = [a.gram[use], np.asarray(keys_of)[text], np.asarray(rows_of)[text], (lo[use] - at[text]).astype(np.int32), (hi[use] - lo[use]).astype(np.int32)]
                segments = pa.array([raw[x:y] for x, y in zip(b.tolist(), e.tolist())], pa.binary())
                for s in range(0, len(use), 10_000):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[s : s + 10_000]) for c in cols), segments.slice(s, 10_000)], names=["gram", "doc_key", "row", "at", "n", "segment"])

    return run


def sort_suffixes(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` words; ``left``: words from each place to the end of its segment. Equal ranks: a common prefix of ``depth`` words (or both the same and shorter)."""
    rank, length = words.astype(np.int64) + 1, 1
    n = len(words)
    while length < depth:
        step = min(length, depth - length)  # prefixes of ``length`` at a place and ``step`` after it make ``length + step``
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = np.where(left[:-step] > step, rank[step:], 0)
        _, rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)
        rank += 1
        length += step
    return rank


def repeats(segments: list[bytes], doc_key: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, suffix in it): the suffixes under a node of depth ``span`` or more that has a smaller document too."""
    ids: dict[bytes, int] = {}
    parts = [[ids.setdefault(w, len(ids)) for w in s.split()] for s in segments]
    size = np.array([*map(len, parts)])
    words = np.array([w for p in parts for w in p], np.int64)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(words))
    rank = sort_suffixes(words, left, span)
    segment = np.repeat(np.arange(len(segments)), n)
    suffix = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    r = rank[begin[segment] + suffix]
    order = np.lexsort((doc_key[segment], r))
    # neighbours with a common prefix of ``span`` words are under one node; its first suffix is of the least document
    segment, suffix, r = segment[order], suffix[order], r[order]
    node = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    least = np.repeat(doc_key[segment[node]], np.diff(np.r_[node, len(r)]))
    gone = doc_key[segment] > least
    return segment[gone], suffix[gone]


def _trees(span: int):
    """Reads whole groups, in order; rows (row, lo, hi): words at which removed windows begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            if not table.num_rows:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["row", "lo", "hi"])
            key, row, at, n = (table.column(c).to_numpy() for c in ("doc_key", "row", "at", "n"))
            segment, suffix = repeats(table.column("segment").to_pylist(), key, n, span)
            start = at[segment] + suffix
            order = np.lexsort((start, row[segment]))
            r, s = row[segment][order], start[order]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]) if len(r) else np.empty(0, np.int64)
            last = np.r_[new[1:] - 1, len(r) - 1] if len(r) else new
            return pa.RecordBatch.from_arrays([pa.array(r[new]), pa.array(s[new].astype(np.int32)), pa.array((s[last] + 1).astype(np.int32))], names=["row", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TREE_BYTES:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                whole = int(np.searchsorted(grams, grams[-1]))  # the last group may go on
                if whole:
                    yield flush(table.slice(0, whole))
                    table = table.slice(whole)
                held, size = table.to_batches(), table.nbytes if whole else 0  # a group is bounded, so is what is held
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _windows(span: int):
    """Rows (w1, w2, doc_key, row, at), one for each suffix: 128 bits of hash of its ``span`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = _words.hashes(*_words.bytes_of(batch.column(5)), LETTERS)
            n = np.asarray(batch.column(4)).astype(np.int64)
            segment = np.repeat(np.arange(len(n)), n)
            suffix = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(counts) - counts)[segment] + suffix
            w1, w2 = (run_hashes(h, span, base)[at] if len(at) else np.empty(0, np.int64) for base in (_B2, _B3))
            cols = [w1, w2, np.asarray(batch.column(1))[segment], np.asarray(batch.column(2))[segment], (np.asarray(batch.column(3))[segment] + suffix).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w1", "w2", "doc_key", "row", "at"])

    return run


def removed_mask(n: int, lo: np.ndarray, hi: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which of ``n`` words are in a window that starts from one of ``lo`` to before ``hi``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.subtract.at(edge, hi + span - 1, 1)
    return np.cumsum(edge[:n]) > 0


def _kept(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(4)
            offsets = np.asarray(ranges.offsets)
            lo, hi = (np.asarray(ranges.values.field(i)).astype(np.int64) for i in (0, 1))
            removed, kept, spans = [], [], []
            for text, n, copy, a, b in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if copy:
                    removed.append(n)
                    kept.append(b"")
                    spans.append([{"start": 0, "end": n}])
                    continue
                words = text.as_py().split()
                if a == b:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                gone = removed_mask(n, lo[a:b], hi[a:b], span)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def _in_hot_groups(segments: DataFrame, span: int) -> DataFrame:
    """(row, lo, hi) of groups of any size: every window is a group of its own, summed up before it is shuffled."""
    each = materialize(segments.mapInArrow(_windows(span), "w1 long, w2 long, doc_key long, row long, at int"), "windows")
    deep = each.groupBy("w1", "w2").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most"), F.count("*").alias("n")).where("least < most").select("w1", "w2", "least", "n")
    hit = join_by_class(each, materialize(deep, "deep"), ["w1", "w2"], "n", each.count()).where("doc_key > least")
    return hit.select("row", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))


def dedup_substrings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans), a row a document: the kept words joined by one space, and the removed spans, by words."""
    binary = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(binary, 256), 1, 32)).alias("th"), binary.alias("text"))
    numbered = materialize(source.mapInArrow(_first_pass(span, gram), "row long, doc_id long, th binary, text binary, n_words long, keys array<long>"), "anchors")
    first = numbered.withColumn("doc_key", F.coalesce("doc_id", F.lit(_LAST)))
    # one document stands for its text
    texts = first.groupBy("th").agg(F.min(F.struct("doc_key", "row")).alias("rep"), F.count("*").alias("n"))
    texts = materialize(texts.select("th", F.col("rep.doc_key").alias("stand"), F.col("rep.row").alias("row"), "n"), "texts")
    listed = materialize(first.where(F.size("keys") > 0).select("row", "keys").join(texts.select("row"), "row", "left_semi").select("row", F.explode("keys").alias("key")), "listed")
    # a prefix that one text has (each is listed once there) is a leaf
    groups = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = join_by_class(listed, groups, "key", "n", listed.count()).groupBy("row").agg(F.collect_list("key").alias("wanted"))
    have = first.select("doc_key", "row", "text").join(wanted, "row").select("doc_key", "row", "text", "wanted")
    segments = materialize(have.mapInArrow(_segments(span, gram), "gram long, doc_key long, row long, at int, n int, segment binary"), "segments")
    hot = materialize(segments.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > group_rows).select("gram"), "hot")
    some_hot = not hot.isEmpty()
    small = segments.join(hot, "gram", "left_anti") if some_hot else segments
    found = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_trees(span), "row long, lo int, hi int")
    if some_hot:
        found = found.unionByName(_in_hot_groups(segments.join(hot, "gram", "left_semi").select(*segments.columns), span))
    ranges = found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    classes = texts.join(ranges, "row", "left").select("th", "stand", "n", F.coalesce("ranges", F.array().cast("array<struct<lo:int,hi:int>>")).alias("ranges"))
    out = join_by_class(first.select("doc_id", "doc_key", "th", "text", "n_words"), classes, "th", "n", first.count())
    copy = (F.col("doc_key") > F.col("stand")) & (F.col("n_words") >= span)
    out = out.select("doc_id", "text", "n_words", copy.alias("copy"), "ranges")
    out = out.mapInArrow(_kept(span), "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_substring": op4_substring}

ORACLE_SQL = {
    "op4_substring": r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from split where len(ws) >= 50)),
least as (select k, min(doc_id) as m from windows group by k having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from windows join least using (k) where doc_id > m),
words as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from split),
kept as (select w.doc_id, string_agg(w.w, ' ' order by w.pos) as t, count(*) as n from words w left join gone g using (doc_id, pos) where g.pos is null group by w.doc_id)
select s.doc_id, len(s.ws)::bigint as n_words, (len(s.ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from split s left join kept k using (doc_id)"""
}
