"""Operator 8, benchmark decontamination: latent semantic retrieval, then checks of words in order and of answers.

Words of all documents are hashed into ``BUCKETS`` features, one vocabulary for the whole corpus and the whole benchmark; document frequencies cover all documents. The matrix A has a
row of length one for each passage (``PASSAGE`` words) of every document and item, weighted by TF-IDF. Its randomised SVD is formed over the cluster: a Gaussian test
matrix T, the products AtA T summed word by word on the executors, their orthonormal basis Q, a power step AtA Q, and the singular values and vectors of the small
matrix that is left. The latent space has ``RANK`` dimensions, whatever the number of items, so words that keep the same company lie together.

A passage is a candidate for an item if their cosine in the latent space is ``MIN_COSINE`` or more, or if the region around it has so many of the item's rarest words that
the checks could be passed by them alone: no copy is passed over, whatever its words weigh. Candidates are checked: the longest common subsequence of words has to cover
``MIN_COVER`` of the item, or ``MIN_COVER_WITH_ANSWER`` together with the item's answer (its rarest words), or, where the latent cosine holds,
``MIN_COVER_LATENT`` with ``MIN_ANSWER_LATENT`` of the answer: a paraphrase in other words.

What a task holds of the benchmark is bounded: it is searched for in blocks of ``ITEMS_PER_BLOCK`` items. They share vocabulary, frequencies and latent space, so blocks change no result.

Defined results: null and empty texts and items match nothing; items with the same words are each reported; equal rows each give rows; a null id is kept in its row; an empty table on
either side gives an empty result; texts of any length are searched whole; bytes that aren't UTF-8 are letters like any other; extra columns, whatever their names, play no part (and stay in
``drop_contaminated``). An item of one or two words is given away by any text that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import map_columns, materialize

ITEMS_PER_BLOCK = 20_000
#: Passages begin every ``STRIDE`` words.
PASSAGE = 32
STRIDE = 16
BUCKETS = 1 << 15
RANK = 32
OVERSAMPLE = 8
#: Words whose vectors are in memory at once.
WORDS_AT_ONCE = 1 << 15
#: Cosines formed at once.
COSINES_AT_ONCE = 1 << 22
#: Passages whose products are formed at once.
ROWS_AT_ONCE = 32
#: Bounds the table by which known words are found, not the words.
MOST_SLOTS = 1 << 22
#: Tasks that sum up the products; a row for each bucket.
SUM_TASKS = 12
MIN_COSINE = 0.8
MIN_COVER = 0.8
MIN_COVER_WITH_ANSWER = 0.5
MIN_COVER_LATENT = 0.4
ANSWER_WORDS = 5
MIN_ANSWER = 0.6
MIN_ANSWER_LATENT = 0.4
#: A candidate by words has so many of an item's rarest words at least.
NEEDED = 3
SEED = 7

#: Punctuation and white space part words; letters are lower-cased (A-Z).
LETTERS = np.frombuffer(bytes(c if c >= 128 or chr(c).isalnum() else 0 for c in range(256)).lower(), np.uint8)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    return _words.hashes(*_words.bytes_of(texts), LETTERS)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return hashes & (BUCKETS - 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each key once, in order; how often it occurs). A plain sort takes a tenth of the time of ``np.unique``."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return keys[first], np.diff(first, append=len(keys))


class Places:
    """Finds words among the ``known`` ones, which are in order: by the last bits of a word, and by search where known words share these."""

    def __init__(self, known: np.ndarray):
        size = min(1 << (4 * len(known)).bit_length(), MOST_SLOTS)
        slot = known & (size - 1)
        self.known = known
        self.slots = np.full(size, len(known), np.int32)
        self.slots[slot] = np.arange(len(known))
        self.shared = np.bincount(slot, minlength=size) > 1

    def __reduce__(self):
        return Places, (self.known,)  # the table is made anew where it is used

    def of(self, words: np.ndarray) -> np.ndarray:
        """The place of each word; ``len(known)`` for others."""
        n = len(self.known)
        slot = words & (len(self.slots) - 1)
        at = self.slots[slot].astype(np.int64)
        other = np.flatnonzero(np.append(self.known, 0)[at] != words)
        at[other] = n
        other = other[self.shared[slot[other]]]
        if len(other):
            found = np.searchsorted(self.known, words[other])
            at[other] = np.where(self.known[np.minimum(found, n - 1)] == words[other], found, n)
        return at


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        m = where.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


def least_share(share: float, n: int) -> int:
    """The least count whose share of ``n`` is ``share`` or more."""
    return next(c for c in range(n + 1) if c >= share * n or c / max(n, 1) >= share)


def block_sums(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each block of ``STRIDE`` words, blocks of each text); ``ends``: where each text's words begin, and the last one's end."""
    n = np.diff(ends)
    blocks = -(-n // STRIDE)
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(ends[:-1], blocks) + STRIDE * (np.arange(blocks.sum()) - first), blocks


def latent_passages(hashes: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latent vectors of length one, of the passages; text of each; word at which each begins). A text without words has no passage."""
    starts, blocks = block_sums(hashes, ends)
    if not len(starts):
        return np.empty((0, word.shape[1]), np.float32), np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, WORDS_AT_ONCE // STRIDE)
    sums = np.empty((len(starts), word.shape[1]), np.float32)
    for i in range(0, len(starts), step):
        j = min(i + step, len(starts))
        stop = starts[j] if j < len(starts) else len(hashes)
        sums[i:j] = np.add.reduceat(word[bucket_of(hashes[starts[i] : stop])], starts[i:j] - starts[i], axis=0)
    text = np.repeat(np.arange(len(blocks)), blocks)
    more = np.r_[text[1:] == text[:-1], False]  # a block after it
    sums[:-1] += np.where(more[:-1, None], sums[1:], 0)
    keep = more | np.repeat(blocks == 1, blocks)
    z = sums[keep]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return z, text[keep], starts[keep]


class Latent:
    """A block of items in the latent space; small, and sent to every task."""

    def __init__(self, items: list[tuple[int, np.ndarray]], df: dict[int, int], word: np.ndarray):
        """``items``: (id, hashes of its words); ``df``: documents that hold each of these; ``word``: latent vector of one occurrence of each bucket."""
        self.word = word
        self.ids = [i for i, _ in items]
        self.known = np.unique(np.concatenate([w for _, w in items]))
        self.places = Places(self.known)
        self.items = [np.searchsorted(self.known, w).tolist() for _, w in items]
        self.z, self.z_item, _ = latent_passages(np.concatenate([w for _, w in items]), np.cumsum([0] + [len(w) for _, w in items]), word)
        self.z_from = np.searchsorted(self.z_item, np.arange(len(items) + 1))
        count = [df.get(int(h), 0) for h in self.known]
        telling = [sorted(set(ws), key=lambda w: (count[w], w)) for ws in self.items]
        self.answers = [set(t[:ANSWER_WORDS]) for t in telling]
        self.of_answer = np.array([least_share(MIN_ANSWER_LATENT, len(a)) for a in self.answers], np.int64)
        answers: list[list[int]] = [[] for _ in self.known]
        for i, a in enumerate(self.answers):
            for w in sorted(a):
                answers[w].append(i)
        self.n_answers = np.array([*map(len, answers), 0])
        self.answers_from = np.cumsum(self.n_answers) - self.n_answers
        self.answer_of = np.array([i for a in answers for i in a], np.int64)
        self.pad = np.array([max(PASSAGE, len(ws)) for ws in self.items])
        # A region that passes the checks by words lacks at most ``spare`` of an item's words or has most of its answer, so it has ``need`` at least of the item's
        # ``spare`` + NEEDED rarest words, the answer among them, whatever these weigh.
        self.least = [least_share(MIN_COVER_LATENT, len(ws)) for ws in self.items]
        self.need = np.ones(len(items), np.int64)
        tells: list[list[int]] = [[] for _ in self.known]
        for i, (ws, t) in enumerate(zip(self.items, telling)):
            spare = len(ws) - least_share(MIN_COVER, len(ws))
            t = t[: max(ANSWER_WORDS, spare + NEEDED)]
            self.need[i] = max(1, min(len(t) - spare, least_share(MIN_ANSWER, len(self.answers[i]))))
            for w in t:
                tells[w].append(i)
        self.n_tells = np.array([*map(len, tells), 0])  # the last: a word outside the benchmark
        self.tells_from = np.cumsum(self.n_tells) - self.n_tells
        self.tells = np.array([i for t in tells for i in t], np.int64)

    @staticmethod
    def _hits(at: np.ndarray, n_of: np.ndarray, begin: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place): where words of an item's list stand, by item and place."""
        where = np.flatnonzero(n_of[at])
        w = at[where]
        n = n_of[w]
        item = items[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        return item[order], np.repeat(where, n)[order]

    def _regions(self, hits: tuple[np.ndarray, np.ndarray], need: np.ndarray, text: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, from, to), by item and place: runs of passages, by the words at which they begin, whose regions hold ``need`` of the item's ``hits`` or more."""
        item, place = hits
        first = np.arange(len(item))
        last = first + need[item] - 1
        first, last = first[last < len(item)], last[last < len(item)]
        pad = self.pad[item[first]]
        near = (item[first] == item[last]) & (text[place[first]] == text[place[last]]) & (place[last] - place[first] < PASSAGE + 2 * pad)
        first, last, pad = first[near], last[near], pad[near]
        item, t = item[first], text[place[first]]
        begin = first_word[t]
        # a passage at s has the region from s - pad to s + PASSAGE + pad
        lo = np.maximum(0, place[last] - begin - PASSAGE - pad + 1)
        hi = place[first] - begin + pad
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (t[1:] != t[:-1]) | (lo[1:] > hi[:-1] + 1)
        at_new = np.flatnonzero(new)
        return t[at_new], item[at_new], lo[at_new], hi[np.r_[at_new[1:], len(item)] - 1] if len(item) else hi

    def _by_words(self, at: np.ndarray, text: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, from, to): runs of passages whose regions can hold enough of the item's rarest words."""
        return self._regions(self._hits(at, self.n_tells, self.tells_from, self.tells), self.need, text, first_word)

    def _by_cosine(self, hashes: np.ndarray, at: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, item, word at which the passage begins, cosine), as near as ``MIN_COSINE`` in the latent space, and with enough of the answer's words around.

        Vectors are formed of texts that have the words, and cosines with the items whose words they are.
        """
        t, item, lo, hi = self._regions(self._hits(at, self.n_answers, self.answers_from, self.answer_of), self.of_answer, text, ends[:-1])
        n = np.diff(ends)
        lo, hi = -(-lo // STRIDE), np.minimum(hi, np.maximum(0, n[t] - STRIDE - 1)) // STRIDE  # the passages, by number
        some = lo <= hi
        t, item, lo, hi = t[some], item[some], lo[some], hi[some]
        if not len(t):
            return []
        used = np.zeros(len(n), bool)
        used[t] = True
        z, z_text, _ = latent_passages(hashes[used[text]], np.concatenate([[0], np.cumsum(n[used])]), self.word)
        first = np.searchsorted(z_text, (np.cumsum(used) - 1)[t])
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i = int(item[a])
            of_item = self.z[self.z_from[i] : self.z_from[i + 1]].T
            size = hi[a:b] - lo[a:b] + 1
            run = np.repeat(np.arange(a, b), size)
            number = lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            step = max(1, COSINES_AT_ONCE // of_item.shape[1])
            for p in range(0, len(run), step):
                r, k = run[p : p + step], number[p : p + step]
                c = (z[first[r] + k] @ of_item).max(1)
                ok = np.flatnonzero(c >= MIN_COSINE)
                found += zip(t[r[ok]].tolist(), [i] * len(ok), (k[ok] * STRIDE).tolist(), c[ok].tolist())
        return found

    def cosine(self, hashes: np.ndarray, i: int) -> float:
        """Of a passage and the item's passage nearest to it, in the latent space."""
        z = self.word[bucket_of(hashes)].sum(0)
        return float((self.z[self.z_item == i] @ z).max() / max(np.linalg.norm(z), 1e-9))

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, cover, answer) of the items that each text gives away; ``counts``: words of each text."""
        if not len(hashes) or not len(self.ids):
            return []
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = self.places.of(hashes)
        text = np.repeat(np.arange(len(counts)), counts)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}

        def check(t: int, i: int, s: int, cosine: float | None) -> None:
            item, pad, begin, end = self.items[i], int(self.pad[i]), int(ends[t]), int(ends[t + 1])
            region = at[max(begin, begin + s - pad) : min(end, begin + s + PASSAGE + pad)].tolist()
            answer = len(self.answers[i].intersection(region)) / len(self.answers[i])
            if cosine is not None and answer < MIN_ANSWER_LATENT:
                return
            cover = common_subsequence(item, region) / len(item)
            latent = cosine is not None and cover >= MIN_COVER_LATENT and answer >= MIN_ANSWER_LATENT
            if cover >= MIN_COVER or cover >= MIN_COVER_WITH_ANSWER and answer >= MIN_ANSWER or latent:
                if (cover, answer) >= best.get((t, i), (0.0, 0.0))[:2]:
                    c = self.cosine(hashes[begin + s : min(end, begin + s + PASSAGE)], i) if cosine is None else cosine
                    best[t, i] = max(best.get((t, i), (0.0, 0.0, -1.0)), (cover, answer, c))

        for t, i, lo, hi in zip(*(x.tolist() for x in self._by_words(at, text, ends[:-1]))):
            n = int(counts[t])
            starts = [s for s in range(-(-lo // STRIDE) * STRIDE, min(hi, max(0, n - STRIDE - 1)) + 1, STRIDE)]
            pad, begin, end = int(self.pad[i]), int(ends[t]), int(ends[t + 1])
            step = 1 + 2 * pad // STRIDE
            for p in range(0, len(starts), step):
                some = starts[p : p + step]
                if len(some) > 1 and common_subsequence(self.items[i], at[max(begin, begin + some[0] - pad) : min(end, begin + some[-1] + PASSAGE + pad)].tolist()) < self.least[i]:
                    continue  # too little even in all of these regions together
                for s in some:
                    check(t, i, s, None)
        for row in self._by_cosine(hashes, at, text, ends):
            check(*row)
        return [(t, self.ids[i], c, cover, answer) for (t, i), (cover, answer, c) in sorted(best.items())]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words: the hashes, eight bytes each), written once; every later pass is made of array operations only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = word_hashes(batch.column(1))
            at = np.concatenate([[0], 8 * np.cumsum(counts)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), words.cast(pa.binary())], names=["id", "words"])

    return materialize(_texts(docs, id_col, text_col).mapInArrow(run, "id long, words binary"), "words")


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = _words.bytes_of(column)
    return data[at[0] : at[-1]].view(np.int64) if at[-1] > at[0] else np.empty(0, np.int64), (at - at[0]) // 8


def _in_slices(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, their texts' ends) of a few texts at a time, or of one."""
    for i, j in _words.slices(ends, WORDS_AT_ONCE):
        yield words[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def _frequencies(hashed: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Documents, how many of them hold each bucket, and each of the ``known`` words: over all documents."""
    sent = hashed.sparkSession.sparkContext.broadcast(known)
    size = BUCKETS + len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(sent.value)
        n = len(places.known)
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for words, ends in _in_slices(*_unpack(batch.column(1))):
                text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                df[:BUCKETS] += np.bincount(distinct(text * BUCKETS + bucket_of(words))[0] % BUCKETS, minlength=BUCKETS)
                if n:
                    at = places.of(words)
                    hit = at < n
                    df[BUCKETS:-1] += np.bincount(distinct(text[hit] * n + at[hit])[0] % n, minlength=n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["w", "df"])

    got = hashed.mapInArrow(run, "w long, df long").groupBy("w").agg(F.sum("df").alias("df")).toArrow()  # a row a bucket and benchmark word
    out = np.zeros(size + 1, np.int64)
    out[got.column("w").to_numpy()] = got.column("df").to_numpy()
    return int(out[-1]), out[:BUCKETS], out[BUCKETS:-1]


def add_products(words: np.ndarray, ends: np.ndarray, idf: np.ndarray, test: np.ndarray, out: np.ndarray) -> None:
    """Adds AtA times ``test`` to ``out``; A: a row of length one for each passage of ``PASSAGE`` words, cut without overlap."""
    n = np.diff(ends)
    passages = -(-n // PASSAGE)
    row = np.repeat(np.cumsum(passages) - passages, n) + (np.arange(len(words)) - np.repeat(ends[:-1], n)) // PASSAGE
    # by groups of rows, then by word: a group's words are found by one sort of them all
    group, row = np.divmod(row, ROWS_AT_ONCE)
    key, k = distinct((group * BUCKETS + bucket_of(words)) * ROWS_AT_ONCE + row)
    column, row = np.divmod(key, ROWS_AT_ONCE)
    new = np.r_[np.ones(min(1, len(key)), bool), column[1:] != column[:-1]]
    of_group = np.searchsorted(column, BUCKETS * np.arange(-(-int(passages.sum()) // ROWS_AT_ONCE) + 1))
    at, w = np.cumsum(new) - 1, bucket_of(column)
    columns = w[new]
    v = k * idf[w]
    passage = column // BUCKETS * ROWS_AT_ONCE + row
    v = (v / np.sqrt(np.maximum(np.bincount(passage, v * v), 1e-12))[passage]).astype(test.dtype)
    for i, j in zip(of_group[:-1].tolist(), of_group[1:].tolist()):
        used = columns[at[i] : at[j - 1] + 1]
        a = np.zeros((ROWS_AT_ONCE, len(used)), test.dtype)  # few words are used by few rows, so it is small
        a[row[i:j], at[i:j] - at[i]] = v[i:j]
        # take in this mode has no check of bounds, and is faster than an index
        y = out.take(used, 0, mode="clip")
        y += a.T @ (a @ test.take(used, 0, mode="clip"))
        out[used] = y


def _products(hashed: DataFrame, items: list[np.ndarray], idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """AtA times ``test`` over the passages of all documents and items; summed on the executors, a row for each bucket comes back."""
    test = test.astype(np.float32)
    sent = hashed.sparkSession.sparkContext.broadcast((idf, test))
    width = test.shape[1]

    def rows_of(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(sums.any(1))
        for i in range(0, len(used), 4096):
            y = sums[used[i : i + 4096]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, width, dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 4096].astype(np.int32)), lists], names=["w", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, t = sent.value
        out = np.zeros((BUCKETS, width))
        for batch in batches:
            for words, ends in _in_slices(*_unpack(batch.column(1))):
                add_products(words, ends, weight, t, out)
        yield from rows_of(out.astype(np.float32))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, width))
        for batch in batches:
            if batch.num_rows:
                w = batch.column(0).to_numpy()
                order = np.argsort(w, kind="stable")
                w, y = w[order], batch.column(1).flatten().to_numpy().reshape(-1, width)[order].astype(float)
                starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                sums[w[starts]] += np.add.reduceat(y, starts, axis=0)
        yield from rows_of(sums)

    out = np.zeros((BUCKETS, width))
    got = hashed.mapInArrow(run, "w int, y array<float>").repartition(SUM_TASKS, "w").mapInArrow(total, "w int, y array<double>").toArrow()
    if got.num_rows:
        out[got.column("w").to_numpy()] = np.array(got.column("y").combine_chunks().flatten()).reshape(-1, width)
    if items:
        add_products(np.concatenate(items), np.cumsum([0, *map(len, items)]), idf, test, out)
    return out


def latent_basis(hashed: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of A (BUCKETS x ``rank``) and its singular values, by a randomised SVD with one power step.

    Range: Q of AtA T. Power step: Y = AtA Q. As AtA is about Y (Qt Y)^-1 Yt, the singular values of Y R^-1, Rt R = Qt Y, are those of A.
    """
    width = min(BUCKETS, rank + OVERSAMPLE)
    test = np.random.default_rng(SEED).standard_normal((BUCKETS, width))
    q, _ = np.linalg.qr(_products(hashed, items, idf, test))
    y = _products(hashed, items, idf, q)
    small = q.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = values > max(values.max(), 0) * 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((width, 0))
    u, s, _ = np.linalg.svd(y @ half, full_matrices=False)
    return u[:, :rank], s[:rank]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> list[tuple[int, np.ndarray]]:
    rows = _texts(benchmark, item_col, item_text_col).toArrow()
    texts = rows.column("text").combine_chunks()
    if not rows.num_rows:
        return []
    h, counts = word_hashes(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
    parts = np.split(h, np.cumsum(counts)[:-1])
    order = sorted(range(len(parts)), key=lambda i: (rows.column("id")[i].as_py() is None, rows.column("id")[i].as_py() or 0, parts[i].tolist()))
    return [(rows.column("id")[i].as_py(), parts[i]) for i in order if len(parts[i])]


def latent_blocks(hashed: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> list[Latent]:
    """The benchmark's blocks in one latent space."""
    items = _items(benchmark, item_col, item_text_col)
    if not items:
        return []
    known = np.unique(np.concatenate([w for _, w in items]))
    n_docs, df, exact = _frequencies(hashed, known)
    idf = np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) + 1e-3
    basis, _ = latent_basis(hashed, [w for _, w in items], idf, rank)
    word = np.ascontiguousarray(idf[:, None] * basis, np.float32)
    counts = dict(zip(known.tolist(), exact.tolist()))
    return [Latent(items[i : i + ITEMS_PER_BLOCK], counts, word) for i in range(0, len(items), ITEMS_PER_BLOCK)]


FOUND = "doc_id long, item_id long, cosine double, cover double, answer double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, cover, answer): the items that each document gives away."""
    spark = docs.sparkSession
    hashed = _hashed(docs, id_col, text_col)
    blocks = [spark.sparkContext.broadcast(b) for b in latent_blocks(hashed, benchmark, item_col, item_text_col, rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, ends in _in_slices(*_unpack(batch.column(1))):
                ids = batch.column(0).slice(at, len(ends) - 1)
                at += len(ends) - 1
                for block in blocks:
                    rows = block.value.search(words, np.diff(ends))
                    cols = list(zip(*rows)) or [[]] * 5
                    out = [ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.float64(), pa.float64())))]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "item_id", "cosine", "cover", "answer"])

    return hashed.mapInArrow(run, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """``docs`` without the rows that give away an item; all columns stay."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in latent_blocks(_hashed(docs, id_col, text_col), benchmark, item_col, item_text_col, rank)]
    if not blocks:
        return docs
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).fill_null(b"")
            h, counts = word_hashes(texts)
            keep = np.ones(batch.num_rows, bool)
            at = 0
            for words, ends in _in_slices(h, np.concatenate([[0], np.cumsum(counts)])):
                for block in blocks:
                    keep[[at + t for t, *_ in block.value.search(words, np.diff(ends))]] = False
                at += len(ends) - 1
            yield batch.filter(pa.array(keep))

    return map_columns(docs, run)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
