"""Normalisation and tokenisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "</s>"
_NUMBER = r"\d+[\d,.]*"


def whitespace_tokens(text: Column) -> Column:
    """Tokens between runs of white space; a null text has none."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda t: t != "")


def tokens_with_breaks(text: Column) -> Column:
    """Lower-cased tokens, with BREAK between lines, so that a line break takes one position."""
    lined = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s*\n\s*", f" {BREAK} ")
    return whitespace_tokens(lined)


def sentences(text: Column) -> Column:
    """Arrays of tokens by line."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\n+"), whitespace_tokens), lambda s: F.size(s) > 0)


def word_tokens(text: Column) -> Column:
    """Words and single punctuation characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), 1)


def normalize_numbers(text: Column) -> Column:
    """Each number becomes ``<nuN>`` with N its length."""
    parts = F.split(text, _NUMBER, -1)
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"({_NUMBER})"), 1), lambda n: F.concat(F.lit("<nu"), F.length(n).cast("string"), F.lit(">")))
    return F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def normalize_punctuation(text: Column) -> Column:
    """A run of one punctuation character becomes that character."""
    return F.regexp_replace(text, r"(\p{Punct})\1+", "$1")


def normalize_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s ]+", " "))


def decode_entities(text: Column) -> Column:
    """The basic entities decoded, all others dropped."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"&[a-zA-Z#0-9]+;", "")


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def separate_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"([()\[\]{}<>])", " $1 ")


def separate_hangul(text: Column) -> Column:
    """A space between Hangul and other characters."""
    text = F.regexp_replace(text, r"([가-힣])([^가-힣\s])", "$1 $2")
    return F.regexp_replace(text, r"([^가-힣\s])([가-힣])", "$1 $2")


def split_punctuation(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Punct}]+"), lambda t: t != "")


def english_normalize(text: Column) -> Column:
    """Numbers marked, spaces collapsed, lower case."""
    return F.lower(normalize_spaces(normalize_numbers(text)))


def ngrams(words: Column, n: int, glue: str = "_") -> Column:
    """Word n-grams in order; an array shorter than n has none."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), glue))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def padded_qgrams(text: Column, q: int) -> Column:
    """Character q-grams of a text with q - 1 pads on either side, with offsets."""
    padded = F.concat(F.lit("\u0002" * (q - 1)), text, F.lit("\u0003" * (q - 1)))
    return F.transform(F.sequence(F.lit(0), F.length(padded) - q), lambda i: F.struct(i.alias("pos"), F.substr(padded, i + 1, F.lit(q)).alias("gram")))


def tag_spans(text: Column, tag: str) -> Column:
    """Texts between ``<tag>`` and ``</tag>``."""
    return F.regexp_extract_all(text, F.lit(f"<{tag}>(.*?)</{tag}>"), 1)


def insert_tags(text: Column, targets: list[str], tag: str) -> Column:
    import re

    found = "|".join(re.escape(t) for t in sorted(targets, key=len, reverse=True))
    return F.regexp_replace(text, f"({found})", f"<{tag}>$1</{tag}>")


def is_upper(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}*$")


def is_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}*$")


def is_hangul(text: Column) -> Column:
    return text.rlike(r"^[가-힣]+$")


def is_english(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z]+$")


def is_number(text: Column) -> Column:
    return text.rlike(r"^[+-]?\d[\d,.]*$")


def is_stop(term: Column, stopwords: list[str]) -> Column:
    """Stop words, number marks, terms that start with punctuation or have no word character, and the unknown mark."""
    return term.isin(stopwords) | F.contains(term, F.lit("<nu")) | term.rlike(r"^\p{Punct}") | term.rlike(r"^[^\p{L}\p{N}]+$") | (term == "<unk>")


def wrap(text: Column, left: str = '"', right: str = '"') -> Column:
    return F.concat(F.lit(left), text, F.lit(right))


def unwrap(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def between(text: Column, left: str, right: str) -> Column:
    """What stands between the first ``left`` and the next ``right``; null if there is no such place."""
    at = F.instr(text, left)
    after = F.substr(text, at + F.lit(len(left)))
    return F.when((at > 0) & F.contains(after, F.lit(right)), F.substring_index(after, right, 1))


def number_filter(term: Column) -> Column:
    """Numbers become ``<N..>`` with the length of each dot-separated part; commas don't count."""
    parts = F.transform(F.split(F.replace(term, F.lit(","), F.lit("")), r"\."), lambda p: F.length(p).cast("string"))
    return F.when(is_number(term), F.concat(F.lit("<N"), F.array_join(parts, "_"), F.lit(">"))).otherwise(term)


def shape(term: Column) -> Column:
    """Upper-case letters as A, lower-case as a, digits as 0, others as they are."""
    for pattern, mark in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"\p{Nd}", "0")):
        term = F.regexp_replace(term, pattern, mark)
    return term


def short_shape(term: Column) -> Column:
    return F.regexp_replace(shape(term), r"(.)\1+", "$1")


def vowel_shape(term: Column) -> Column:
    """Vowels as v, consonants as c, others as they are."""
    term = F.regexp_replace(F.lower(term), "[bcdfghjklmnpqrstvwxyz]", "\u0001")
    return F.translate(F.regexp_replace(term, "[aeiou]", "v"), "\u0001", "c")


def token_features(term: Column) -> Column:
    """The features of a token: affixes, shapes, case, vowels."""
    return F.struct(
        F.lower(term).alias("word"), F.substr(term, F.greatest(F.length(term) - 2, F.lit(1))).alias("suffix"), F.left(term, F.lit(3)).alias("prefix"),
        term.rlike(r"^\p{Punct}+$").alias("punct"), term.rlike(r"^\p{Lu}").alias("caps"), shape(term).alias("shape"), short_shape(term).alias("short_shape"), vowel_shape(term).alias("vowels"),
    )


def of_length(term: Column, least: int, most: int) -> Column:
    return F.length(term).between(least, most)


def is_digits(term: Column) -> Column:
    """Groups of digits with single commas or points between them, without a sign."""
    return term.rlike(r"^[0-9]+([.,][0-9]+)*$")


def is_punctuation(term: Column) -> Column:
    """No letter and no digit."""
    return ~term.rlike(r"[\p{L}\p{N}]")


def analyzed(tokens: DataFrame, stopwords: list[str], least: int = 2, most: int = 20) -> DataFrame:
    """Tokens (with a column ``term``) after length, punctuation and stopword filters, with numbers marked by their length."""
    x = F.col("term")
    kept = tokens.filter(of_length(x, least, most) & ~is_punctuation(x) & ~x.isin(stopwords))
    return kept.withColumn("term", F.when(is_digits(x), F.concat(F.lit("<nu"), F.length(x).cast("string"), F.lit(">"))).otherwise(x))


def _char(code: Column) -> Column:
    """The character of a code below 65,536."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _code(char: Column) -> Column:
    return F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long")


#: Fixed values of the Unicode standard: first syllable, leading consonant, vowel and one before the first trailing consonant; vowels times trailing places, and those.
_SYLLABLE, _LEAD, _VOWEL, _TRAIL, _BY_LEAD, _BY_VOWEL = 0xAC00, 0x1100, 0x1161, 0x11A7, 588, 28


def hangul_decomposed(text: Column) -> Column:
    """Syllables as their jamo, other characters as they are."""

    def parts(c: Column) -> Column:
        k = _code(c) - _SYLLABLE
        jamo = F.concat(_char(F.floor(k / _BY_LEAD) + _LEAD), _char(F.floor(F.pmod(k, F.lit(_BY_LEAD)) / _BY_VOWEL) + _VOWEL), F.when(F.pmod(k, F.lit(_BY_VOWEL)) > 0, _char(F.pmod(k, F.lit(_BY_VOWEL)) + _TRAIL)).otherwise(""))
        return F.when(c.rlike("[가-힣]"), jamo).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), parts), "")


def hangul_composed(text: Column) -> Column:
    """Jamo of whole syllables as these, other characters as they are."""
    units = F.regexp_extract_all(text, F.lit("([ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|(?s:.))"), F.lit(1))

    def one(u: Column) -> Column:
        lead, vowel = _code(F.substr(u, F.lit(1), F.lit(1))) - _LEAD, _code(F.substr(u, F.lit(2), F.lit(1))) - _VOWEL
        trail = F.when(F.length(u) > 2, _code(F.substr(u, F.lit(3), F.lit(1))) - _TRAIL).otherwise(0)
        return F.when(u.rlike("^[ᄀ-ᄒ][ᅡ-ᅵ]"), _char(F.lit(_SYLLABLE) + lead * _BY_LEAD + vowel * _BY_VOWEL + trail)).otherwise(u)

    return F.array_join(F.transform(units, one), "")
