"""Text expressions: tokens, sentences, overlap, hashed-gram buckets.

T1 T2 T3 P13 P18 P19 and the bucket function of T5, all as Catalyst
expressions (regex and array functions run in the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RE = "[a-z0-9]+"
SENTENCE_RE = "[^.!?]+[.!?]"
# Same matches as SENTENCE_RE, but an unterminated tail is consumed in one
# match (and dropped afterwards) instead of being retried from every start
# position, which is quadratic in the tail length.
_SENTENCE_SCAN_RE = "[^.!?]+(?:[.!?]|\\z)"
WORD_RE = "(?U)[^\\s\\x1c-\\x1f]+"  # any Unicode white space separates


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case alphanumeric runs, in order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RE), 0)


def words(text) -> Column:
    """Whitespace-separated words (chunking unit)."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD_RE), 0)


def strip(c) -> Column:
    """Strip leading/trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sentence_matches(text) -> Column:
    """All matches of SENTENCE_RE (unstripped), in order."""
    raw = F.regexp_extract_all(_col(text), F.lit(_SENTENCE_SCAN_RE), 0)
    return F.filter(raw, lambda s: F.substring(s, -1, 1).isin(".", "!", "?"))


def sentences(text, keep_whole: bool = False) -> Column:
    """Terminated sentences, stripped, blanks dropped.

    No sentence found -> [stripped text] (or [] when that is blank); with
    ``keep_whole`` the whole text is kept as-is (generator variant).
    """
    t = F.coalesce(_col(text), F.lit(""))
    found = F.filter(F.transform(sentence_matches(t), strip), lambda s: F.length(s) > 0)
    if keep_whole:
        fallback = F.array(t)
    else:
        st = strip(t)
        fallback = F.when(F.length(st) > 0, F.array(st)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def raw_sentences(text) -> Column:
    """Generator variant of T3: stripped matches (blanks kept), else [text]."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.transform(sentence_matches(t), strip)
    return F.when(F.size(found) > 0, found).otherwise(F.array(t))


def overlap(a_tokens, b_tokens) -> Column:
    """|distinct(a) & distinct(b)| / (|distinct(a)| + 1e-9)."""
    a = F.array_distinct(_col(a_tokens))
    return F.size(F.array_intersect(a, _col(b_tokens))) / (F.size(a) + F.lit(1e-9))


def grams(tok) -> Column:
    """Unigrams followed by adjacent bigrams 'a_b'."""
    t = _col(tok)
    n = F.size(t)
    bi = F.when(n > 1, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                                  lambda a, b: F.concat(a, F.lit("_"), b))) \
          .otherwise(F.array().cast("array<string>"))
    return F.concat(t, bi)


def md5_bucket(gram, dim: int) -> Column:
    """int(md5(gram), 16) mod dim, computed exactly.

    The 128-bit value is folded 16 bits at a time (Horner's rule modulo
    ``dim``), so any dim up to 2**31 works; for dim dividing 65536 only the
    last digits matter but the fold gives the same value.
    """
    h = F.md5(_col(gram))
    if 65536 % dim == 0:
        return (F.conv(F.substring(h, 29, 4), 16, 10).cast("int") % F.lit(dim)).cast("int")
    acc = F.lit(0).cast("bigint")
    for i in range(8):
        part = F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("bigint")
        acc = (acc * F.lit(65536) + part) % F.lit(dim)
    return acc.cast("int")


def approx_tokens(text) -> Column:
    """max(1, length div 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("int"))


def numbered_context(contexts) -> Column:
    """P19: '[1] text' blocks joined by a blank line."""
    return F.array_join(F.transform(_col(contexts), lambda c, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
