"""Operator 10, secret scans: credential patterns, and a token-efficiency test for random strings.

A random string needs about one token for every one or two characters of a byte-pair vocabulary; words and identifiers need far fewer.
A run of key characters that has both letters and digits and is long enough is a secret if its characters per token fall under a threshold,
unless it is a known digest (hex of a usual length), a UUID, or part of a URL, path, mail address or dotted name.

Defined results: a null text counts as empty (no spans); spans are in code points, end exclusive; spans at one start are ordered
assign, access, hex, random; equal rows each give a row; an empty table gives an empty result; texts of any length are scanned whole; bytes
that aren't UTF-8 count as the replacement character; extra columns, whatever their names, play no part (and stay in ``redact_secrets``).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_columns

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: A cheap necessary condition of ASSIGN; most texts have no match.
MAYBE_ASSIGN = re.compile(r"""(?i:passw|secret|token|api_?key)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.\-@:%]{16,}")
#: A random run has a digit; most texts have none.
DIGIT = re.compile(r"[0-9]")
KINDS = ("assign", "access", "hex", "random")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
KEY = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
MAX_CHARS_PER_TOKEN = 2.2
VOCABULARY = "byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tiktoken encoding of a vocabulary file of /opt/tokenizers (or a path); one a process."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers as P
        import tiktoken

        path = vocabulary if "/" in vocabulary else P.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds numbered as in KINDS."""
    out = []
    if MAYBE_ASSIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str, limit: float) -> list[tuple[int, int, int]]:
    """(start, 3, end) of runs that the vocabulary compresses badly and that no base span touches."""
    out = []
    if not DIGIT.search(text):
        return out
    for r in RUN.finditer(text):
        run = r.group()
        if "://" in run or "@" in run or run.count("/") > 3 and run.startswith("/"):
            continue  # URLs, mail addresses, paths
        for m in KEY.finditer(run):
            s = m.group()
            if not (DIGIT.search(s) and any(c.isalpha() for c in s)) or DIGEST.fullmatch(s) or UUID.fullmatch(s):
                continue
            a, b = r.start() + m.start(), r.start() + m.end()
            if len(s) / len(encoder(vocabulary).encode_ordinary(s)) < limit and not any(x < b and a < y for x, _, y in base):
                out.append((a, 3, b))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.string()), ("base", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row a document: (doc_id, spans, base, n_assign, n_access, n_hex, n_random). One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                text = (text or b"").decode(errors="replace")
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, vocabulary, max_chars_per_token))
                kinds = [k for _, k, _ in every]
                for c, v in zip(cols, (join_spans(every), join_spans(base), *(kinds.count(k) for k in range(4)))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(SCHEMA)[1:7]))], names=SCHEMA.names[:7])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, spans string, base string, n_assign long, n_access long, n_hex long, n_random long"
    )


def redact(text: str, vocabulary: str = VOCABULARY, limit: float = MAX_CHARS_PER_TOKEN, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    base = base_spans(text)
    spans = sorted(base + random_spans(text, base, vocabulary, limit))
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; all other columns, and null texts, stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                text = (raw or b"").decode(errors="replace")
                new = redact(text, vocabulary, max_chars_per_token)
                texts.append(raw if new == text else new.encode())  # bytes that aren't UTF-8 stay where there is nothing to replace
            cols = batch.columns
            cols[at] = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema.set(at, pa.field(batch.schema.names[at], pa.string())))

    return map_columns(docs.withColumn(text_col, F.col(text_col).cast("string")), run)


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


QUERIES = {"op10_secrets": op10_secrets}
