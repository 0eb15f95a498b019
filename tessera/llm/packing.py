"""Operator 2, packing: token sequences of near-equal fill by Karmarkar-Karp multiway differencing.

A document's whole sequences fill a window each, so there is nothing to difference in them; what remains (under one sequence) is cut into up to ``sequence / cut`` pieces. The pieces of
``docs_per_group`` documents are differenced into windows: the two partial partitions with the largest spreads are merged again and again, one's fullest windows with the other's emptiest.
The count of windows begins at the least that could hold the group and rises whenever differencing leaves one over its capacity. So that differencing can get windows
nearly equal, a few documents of each group are cut finely (``GRAINS`` pieces a window, of ``GRAIN`` ids or so): the last merges level with them. Where that leaves much room, more
documents are, each into pieces of a size of its own: pieces all alike fill a window only by chance.
A task packs what it reads, so nothing is shuffled, and a sequence never spans two tasks.

Defined results: a null text counts as empty and holds the closing id alone; equal rows are packed each; an empty table gives no piece; an
empty group none; texts of any length are encoded whole; bytes that aren't UTF-8 count as the replacement character; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import id_text
from ._kk import kk_states

SEQUENCE = 2048
CUT = 512
DOCS_PER_GROUP = 512
#: Fine pieces a window, and their length.
GRAINS = 3
GRAIN = 48
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids are remembered by a task; the memory starts anew when full.
WORDS_KEPT = 500_000
LONGEST_WORD_KEPT = 64

_ENCODERS: dict[str, Encoder] = {}

#: In these words NFC changes nothing and lower case is the same everywhere, so they can be parted here.
PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]*")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for the bytes 0 to 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its words, one after the other; words, and the parts that the vocabulary's own
    pattern makes of them, come again and again and are remembered. Words that aren't plain go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else P.path(vocabulary))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, p: str) -> bytes:
        ids = self.parts.get(p)
        if ids is None:
            s = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])  # printable ASCII is written as itself
            ids = array("I", [t.id for t in self.model.tokenize(s)]).tobytes()
            if len(self.parts) >= WORDS_KEPT:
                self.parts = {}
            self.parts[p] = ids
        return ids

    def word(self, w: bytes) -> bytes:
        if w.isalpha() and len(w) <= LONGEST_WORD_KEPT:  # ASCII letters: one part
            return self.part(w.lower().decode())
        s = w.decode(errors="replace")
        if len(w) <= LONGEST_WORD_KEPT and "<|" not in s and PLAIN.fullmatch(s):
            return b"".join([self.part(p) for p in PARTS.findall(s.lower())])
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Workers outlive tasks, and other stages need the memory."""
        self.words, self.parts = {}, {}

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            pass
        new = {w: self.word(w) for w in set(words).difference(self.words)}
        known = self.words
        out = b"".join([known[w] if w in known else new[w] for w in words])
        if len(known) + len(new) > WORDS_KEPT:
            self.words = known = {}
        known.update((w, v) for w, v in new.items() if len(w) <= LONGEST_WORD_KEPT)
        return out


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary file of /opt/tokenizers (or a path); one a process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cuts(n: int, sequence: int = SEQUENCE, cut: int = CUT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then near-equal pieces of at most ``cut``."""
    whole, rest = divmod(n, sequence)
    out = [(i * sequence, sequence) for i in range(whole)]
    k = -(-rest // cut)
    at = whole * sequence
    for j in range(k):
        size = rest * (j + 1) // k - rest * j // k
        out.append((at, size))
        at += size
    return out


def group_cuts(lengths: list[int], sequence: int = SEQUENCE, cut: int = CUT, grains: int = GRAINS, grain: int = GRAIN, sizes: int = 1) -> list[tuple[int, int, int]]:
    """(document, start, length) of the pieces of a group; the documents with the longest remainders are cut finely until there are enough fine pieces.

    Fine pieces have ``grain`` ids at most, or so many less as the document comes after others that are cut finely, counted up to ``sizes``.
    """
    rest = [n % sequence for n in lengths]
    wanted = grains * -(-sum(rest) // sequence)
    fine: dict[int, int] = {}
    for d in sorted(range(len(lengths)), key=lambda d: (-rest[d], d)):
        if wanted <= 0:
            break
        fine[d] = grain - len(fine) % sizes
        wanted -= -(-rest[d] // grain)
    return [(d, at, m) for d, n in enumerate(lengths) for at, m in cuts(n, sequence, min(fine.get(d, cut), cut))]


def windows(sizes: np.ndarray, sequence: int = SEQUENCE, grain: int = GRAIN) -> tuple[np.ndarray, int]:
    """Window of each piece, and their number: the least from which on differencing fits all into their capacity.

    Pieces over ``grain`` begin as partial partitions of as many pieces as there are windows, alike in size; fine ones as partitions of one piece.
    """
    large = np.argsort(-sizes, kind="stable")
    large = large[sizes[large] > grain]
    fine = np.flatnonzero(sizes <= grain)
    k = max(1, -(-int(sizes.sum()) // sequence))
    while True:
        members = [large[i : i + k] for i in range(0, len(large), k)] + [fine[i : i + 1] for i in range(len(fine))]
        sums, slots = kk_states([sizes[m] for m in members], k)
        if sums[0] <= sequence:
            part = np.empty(len(sizes), np.int64)
            for m, s in zip(members, slots):
                part[m] = s
            return part, k
        k += max(1, -(-int(np.maximum(sums - sequence, 0).sum()) // sequence))


def group_windows(lengths: list[int], sequence: int = SEQUENCE, cut: int = CUT, grains: int = GRAINS, grain: int = GRAIN) -> tuple[list[tuple[int, int, int]], np.ndarray, int]:
    """(pieces of under a whole sequence and of whole ones, window of the former in order, number of windows); where pieces alike in size would leave much room, more of them are fine, and of many sizes."""
    some = 1
    while True:
        pieces = group_cuts(lengths, sequence, cut, grains, grain, some)
        sizes = np.array([m for _, _, m in pieces if m < sequence], np.int64)
        if not len(sizes):
            return pieces, np.empty(0, np.int64), 0
        part, k = windows(sizes, sequence, grain)
        least = -(-int(sizes.sum()) // sequence)
        if k <= least + max(1, least // 100) or grains * grain >= sequence:
            return pieces, part, k
        grains *= 4
        some = max(1, 2 * grain // 3)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, cut: int = CUT, docs_per_group: int = DOCS_PER_GROUP) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 36
        group: list[tuple[int | None, bytes]] = []  # documents and their ids

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            rows: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset
            pieces, part, k = group_windows([len(ids) // 4 for _, ids in group], sequence, cut)
            filled = [0] * k
            window = iter(part.tolist())
            whole = next_id + k
            for d, start, length in pieces:
                if length == sequence:
                    rows.append((d, start, length, whole, 0))
                    whole += 1
                else:
                    w = next(window)
                    rows.append((d, start, length, next_id + w, filled[w]))
                    filled[w] += length
            next_id = whole
            ids = [group[d][1][4 * s : 4 * (s + m)] for d, s, m, _, _ in rows]
            crc = [zlib.crc32(x) for x in ids]
            a = np.array(rows, np.int64).reshape(-1, 5)
            ends = np.concatenate([[0], np.cumsum(a[:, 2])]).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([group[r[0]][0] for r in rows], pa.int64()), pa.array(a[:, 1].copy()), pa.array(a[:, 2].copy()), pa.array(crc, pa.int64()),
                    pa.array([len(group[r[0]][1]) // 4 for r in rows], pa.int64()), pa.array(a[:, 3].copy()), pa.array(a[:, 4].copy()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            group.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                group.append((doc_id, enc.encode(text.as_py() or b"") + end))
                if len(group) >= docs_per_group:
                    yield flush()
        if group:
            yield flush()
        enc.forget()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


QUERIES = {"op2_packing": op2_packing}
