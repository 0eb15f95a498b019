"""Text as columns: tokens, n-grams, prefixes, suffixes, cleaning. All built-in expressions, inside code generation or not at all in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, CHAR, CHAR_IN_WORD = "word", "char", "char_wb"
TOKENIZER_CODES = {WORD: 10, CHAR: 20, CHAR_IN_WORD: 30}


def words(text: Column | str) -> Column:
    """Split on the single space only; empty tokens go. No case folding; tabs and punctuation stay."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def chars(text: Column | str) -> Column:
    """Code points."""
    return F.filter(F.split(text, ""), lambda x: x != "")


def padded_words(text: Column | str) -> Column:
    """Words with a space on both sides, as arrays of code points."""
    return F.transform(words(text), lambda w: chars(F.concat(F.lit(" "), w, F.lit(" "))))


def tokens(text: Column | str, kind: str = WORD, max_length: int = 0) -> Column:
    """``max_length`` tokens at most, if positive."""
    t = {WORD: words, CHAR: chars}[kind](text)
    return F.slice(t, 1, max_length) if max_length > 0 else t


def _grams(t: Column, n: int) -> Column:
    """Runs of exactly ``n`` tokens: each run of n - 1 with the token after it, so an array is walked n times and never searched."""
    out = F.transform(t, lambda x: F.array(x))
    for k in range(1, n):
        fewer = F.greatest(F.size(t) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), fewer), F.slice(t, F.lit(k + 1), fewer), lambda g, x: F.concat(g, F.array(x)))
    return out


def ngrams(toks: Column | str, low: int, high: int) -> Column:
    """Contiguous runs of ``low`` to ``high`` tokens, as arrays. ``toks`` should be a column that is there already, or it is evaluated again and again."""
    t = F.col(toks) if isinstance(toks, str) else toks
    parts = [_grams(t, n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def joined_ngrams(toks: Column | str, n: int, sep: str) -> Column:
    """Contiguous runs of exactly ``n`` tokens as strings: n shifted copies of the array, put together place by place."""
    t = F.col(toks) if isinstance(toks, str) else toks
    out = t
    for k in range(1, n):
        fewer = F.greatest(F.size(t) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), fewer), F.slice(t, F.lit(k + 1), fewer), lambda g, x: F.concat(g, F.lit(sep), x))
    return out


def token_ids(toks: Column | str, vocabulary: dict[str, int]) -> Column:
    """Ids of tokens, -1 for one that the vocabulary lacks."""
    t = F.col(toks) if isinstance(toks, str) else toks
    known = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv)) if vocabulary else F.lit(None).cast("map<string,int>")
    return F.transform(t, lambda x: F.coalesce(F.element_at(known, x), F.lit(-1)))


_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(text: Column | str) -> Column:
    """Letters of Latin-1 without their marks; combining marks that stand alone go."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.translate(t, _MARKED, _BARE), r"[\u0300-\u036f]", "")


def parse_list(text: Column | str, sep: str = ",") -> Column:
    """The parts of a list written as text, brackets and quotes around them left out: ``"['a', 'b']"`` gives a and b."""
    t = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_replace(F.trim(t), r"^[\[(]|[\])]$", "")
    parts = F.transform(F.split(inner, sep, -1), lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2"))
    return F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(parts)


def positioned_ngrams(toks: Column | str, low: int, high: int) -> Column:
    """As ``ngrams``, each with its place; places start at 0 for every length."""
    t = F.col(toks) if isinstance(toks, str) else toks
    parts = [F.transform(_grams(t, n), lambda g, i: F.struct(g.alias("g"), i.alias("i"))) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def word_ngrams_in_words(text: Column | str, low: int, high: int) -> Column:
    """n-grams of code points that stay within a padded word."""
    return F.flatten(F.transform(padded_words(F.col(text) if isinstance(text, str) else text), lambda w: ngrams(w, low, high)))


def clean_query(text: Column | str) -> Column:
    """Lower case; split on white space and dots; only word characters stay; empty parts go."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(F.lower(F.trim(t)), r"[\s.]+"), lambda w: F.regexp_replace(w, r"[^a-z0-9_]+", ""))
    return F.array_join(F.filter(parts, lambda w: w != ""), " ")


def prefix(text: Column | str, n: Column | int) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t.substr(F.lit(1), F.lit(n) if isinstance(n, int) else n)


def prefixes(text: Column | str) -> Column:
    """All prefixes, the empty one included."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.sequence(F.lit(0), F.length(t)), lambda n: t.substr(F.lit(1), n))


def word_suffixes(text: Column | str) -> Column:
    """The text from each word on."""
    w = words(text)
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))).otherwise(F.array().cast("array<string>"))


def byte_prefix(text: Column | str, n: int) -> Column:
    """The first ``n`` bytes of UTF-8; a character may be split."""
    return F.substring(F.encode(text, "UTF-8"), 1, n)


def sklearn_words(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def join_prefix(query: Column, pre: Column, mark: str = "<@@>") -> Column:
    return F.concat_ws(mark, query, pre)


def ranker_prompt(query: Column, contents: list[Column], query_prefix: str = "", passage_prefix: str = "", sep: str = " ") -> tuple[Column, Column]:
    """Query and passage strings; dashes of the first field become spaces, and null fields are left out."""
    first = F.regexp_replace(contents[0], "-", " ")
    passage = F.concat_ws(sep, first, *contents[1:])
    return F.trim(F.concat(F.lit(query_prefix), query)), F.trim(F.concat(F.lit(passage_prefix), passage))
