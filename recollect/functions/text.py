"""Text as column expressions: tokens, terms, phrases, tags, summaries, names; and the analysis of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a query.
STOPWORDS = frozenset(
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must can this that these those".split()
)
#: Words that are no tags: those and the pronouns.
NO_TAGS = STOPWORDS | frozenset("i you he she it we they me him her us them my your his its our their".split())


@dataclass(frozen=True)
class Query:
    """A query's text, lower-cased; terms as they stand; words without stopwords; phrases of two and three words, repeats and all."""

    text: str
    original: tuple[str, ...]
    processed: tuple[str, ...]
    phrases: tuple[str, ...]
    n_words: int

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(sorted({*self.original, *self.processed}))


def query(text: str) -> Query:
    parts = text.split()
    low = text.lower()
    original = sorted({p.lower() for p in parts if len(p) > 2})
    processed = sorted({w for w in re.findall(r"\b\w+\b", low) if len(w) > 2 and w not in STOPWORDS})
    w, phrases = low.split(), []
    for i in range(len(w) - 1):
        for size, longer in ((2, 5), (3, 8)):
            phrase = " ".join(w[i : i + size])
            if i + size <= len(w) and len(phrase) > longer:
                phrases.append(phrase)
    return Query(low, tuple(original), tuple(processed), tuple(phrases), len(parts))


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, in any script, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def tokens(c: Column) -> Column:
    """What stands between white space, lower-cased."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def index_terms(c: Column) -> Column:
    """Distinct tokens of more than two characters."""
    return F.array_distinct(F.filter(tokens(c), lambda x: F.length(x) > 2))


def content_words(c: Column) -> Column:
    """Distinct words of more than two characters that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in sorted(STOPWORDS)])
    return F.array_distinct(F.filter(words(c), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x)))


def has_word(low: Column, word: str) -> Column:
    """Whether the word is among words(c), given c lower-cased; the text isn't taken apart, and only searched closely where the word occurs in it."""
    if not re.fullmatch(r"\w+", word):
        return F.lit(False)
    return low.contains(word) & low.rlike(rf"(?U)(?<!\w){word}(?!\w)")


def has_token(low: Column, token: str) -> Column:
    """Whether the token is among tokens(c), given c lower-cased."""
    quoted = "".join(x if x.isalnum() or ord(x) > 127 else "\\" + x for x in token)
    return low.contains(token) & low.rlike(rf"(?:\A|\s){quoted}(?:\s|\z)")


def strings(values) -> Column:
    """A constant array of strings, empty ones too."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def hits(terms, inside) -> Column:
    """How many of the constant terms satisfy a predicate of one term."""
    total = F.lit(0)
    for t in terms:
        total = total + F.coalesce(inside(t), F.lit(False)).cast("int")
    return total


def simple_tags(c: Column, most: int = 10) -> Column:
    """The first distinct words of three or more of the letters a to z, stopwords and pronouns aside."""
    plain = F.filter(words(c), lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*sorted(NO_TAGS)))
    return F.slice(F.array_distinct(plain), 1, most)


def name_tags(c: Column, most: int = 10) -> Column:
    """Capitalised words, then hashtags, distinct, in order of appearance."""
    names = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda x: x.rlike("^[A-Z][a-z]+$"))
    return F.slice(F.array_distinct(F.concat(names, F.regexp_extract_all(c, F.lit(r"(?U)#(\w+)"), F.lit(1)))), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def summary(c: Column, most: int = 100) -> Column:
    """c itself if short; else its beginning up to the last space, if that lies beyond 70 %, and three dots."""
    head = F.substring(c, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # from 0
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when((F.instr(head, " ") > 0) & (space > most * 0.7), F.substring(head, F.lit(1), space)).otherwise(head), F.lit("...")))


def file_name(c: Column, most: int = 100) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"[\s_]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(F.length(s) > most, F.regexp_replace(F.substring(s, 1, most), "_+$", "")).otherwise(s)
    return F.when(s == "", "unnamed").otherwise(s)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def chunks(c: Column, size: int = 1000) -> Column:
    """An array of (chunk_no, chunk): slices of `size` characters; one, and empty, for an empty text."""
    last = F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_no"), F.substring(c, i * size + 1, F.lit(size)).alias("chunk")))


def record_bytes(content: Column, node_type: Column, version_of: Column, tags: Column, link_types: Column) -> Column:
    """Bytes of a memory in the binary record format; see sources.mex."""
    total = 67 + F.octet_length(node_type) + F.octet_length(content) + F.when(version_of.isNotNull(), 36).otherwise(0)

    def bytes_of(array: Column, each: int) -> Column:
        return F.aggregate(F.coalesce(array, F.array().cast("array<string>")), F.lit(0), lambda n, x: n + each + F.octet_length(x))

    return total + bytes_of(tags, 1) + bytes_of(link_types, 41)


def codec_for(size: Column) -> Column:
    return F.when(size < 1024, "lz4/1").when(size < 10240, "zlib/5").otherwise("blosc/9")


def to_seconds(at: Column) -> Column:
    """Seconds since 1970, with fractions, of a timestamp."""
    return F.unix_micros(at) / 1e6


def from_seconds(s: Column) -> Column:
    """The timestamp that lies so many seconds, with fractions, after 1970."""
    return F.timestamp_micros((s * 1e6).cast("long"))


def tag_of(name: str) -> str:
    """A name as a tag: words in lower case, joined by underscores."""
    return "_".join(re.findall(r"\w+", name.lower()))
