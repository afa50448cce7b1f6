"""Column functions on source text, messages, paths, urls and patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the naive tokenizer as one regex (escape pairs, words, single marks; other characters join what precedes).
TOKEN = r"\\.|\\|[A-Za-z0-9_]+[^\x00-\x7F]*|[!-/:-@\[\]^`{-~][^\x00-\x7F]*|[^\x00-\x7F]+"
#: Fixed value: suffixes of source files; only .c carries its dot.
SOURCE_FILE = r"([.]c|php|rb|py|java|cpp|scala|js|h|cc|pl|hpp)$"
#: The characters of each class of the tokenizers; letters and digits besides.
CHAR_CLASSES = {
    "operator": "+-*/%~&|^=<>?:!",
    "parenthesis": "(){}[]",
    "punctuation": ",; .",
    "string_mark": "'\"",
    "meaningless": "@$`#",
}
#: Operators of two characters.
PAIR_OPERATORS = ("==", "!=", "<=", "&&", "~=", "||", "::", "<<", ">>", ">=", "++", "--", "-=", "+=", "*=", "/=", "%=", "^=", "&=", "|=", "//", "/*", "*/")


def tokens(text: Column) -> Column:
    """Array of the naive tokenizer's tokens."""
    return F.regexp_extract_all(F.trim(text), F.lit(TOKEN), F.lit(0))


def is_entity(token: Column) -> Column:
    """Does a token begin with a letter or underscore?"""
    return token.rlike("^[A-Za-z_]")


def is_number(token: Column) -> Column:
    return token.rlike("^[0-9]")


def char_class(c: Column) -> Column:
    """The class of a single character, ``other`` if it has none."""
    out = F.when(c.rlike("^[A-Za-z_]$"), "entity").when(c.rlike("^[0-9]$"), "digit")
    for name, members in CHAR_CLASSES.items():
        out = out.when(c.isin(*members), name)
    return out.otherwise("other")


def ngrams(array: Column, n: int, glue: str = ":") -> Column:
    """Array of the ``n``-grams of an array of strings, members joined by ``glue``."""

    def whole(a: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), glue))
        return F.when(F.size(a) >= n, grams).otherwise(F.array().cast("array<string>"))

    # the array is bound once; an expression named inside the inner lambda would be computed for each n-gram
    return F.get(F.transform(F.array(array), whole), F.lit(0))


def split_names(name: Column) -> Column:
    """Parts of dotted or colon-joined names, empty ones left out."""
    return F.filter(F.split(name, "[.:]"), lambda p: p != "")


def refined(ngram: Column, n: int) -> Column:
    """n-grams of an n-gram's members after marks within them are read as dots and split."""
    parts = F.filter(F.split(F.translate(ngram, "%#&@:,=[]", "........."), "[.]"), lambda p: p != "")
    return ngrams(parts, n, ".")


def file_extension(path: Column) -> Column:
    """What follows the last dot; of that, what follows the last slash."""
    return F.element_at(F.split(F.element_at(F.split(path, "[.]"), -1), "/"), -1)


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE)


def is_bug_fix(message: Column) -> Column:
    """Does a message name an issue number and a word of closing?"""
    low = F.lower(message)
    return low.rlike("#[0-9]+") & low.rlike("close|resolve|fix")


def issue_numbers(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit("#([0-9]+)"), F.lit(1))


def email_local(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(1)))


def name_characters(name: Column) -> Column:
    """Sorted set of a name's characters, lower-cased."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), ""), lambda c: c != "")))


def actor_name(committer_login: Column, author_login: Column, committer_name: Column, author_name: Column) -> Column:
    """The first identity known of a commit."""
    return F.coalesce(committer_login, author_login, committer_name, author_name, F.lit("null null"))


def repo_of_url(url: Column, prefix: str = r"^https?://[^/]*/repos/") -> Column:
    """A repository's key: the url without its API prefix, slashes as underscores."""
    return F.translate(F.regexp_replace(url, prefix, ""), "/", "_")


def parsed_date(text: Column) -> Column:
    """Timestamps of the three layouts that the logs use; null for any other."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("MM/dd/yyyy", "yyyy-MM-dd_HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX")))


def url_domain(url: Column) -> Column:
    """Host of a url without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def url_site(url: Column) -> Column:
    """The last two labels of a url's host."""
    return F.regexp_extract(url_domain(url), r"([^.]+\.[^.]+)$", 1)


def normal_url(url: Column) -> Column:
    """A url without scheme, www, query, fragment and the slashes before them, lower-cased."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://(www\.)?", ""), r"/*([?#].*)?$", "")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def clean_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def latin_share(text: Column) -> Column:
    """Share of ASCII letters, digits and blanks among a text's characters."""
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9 ]", "")) / F.length(text)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def standard_author(name: Column) -> Column:
    """``First Middle Last`` -> ``last_f``: last name and first initial, lower-cased."""
    parts = F.split(F.trim(F.lower(name)), " +")
    return F.concat(F.element_at(parts, -1), F.lit("_"), F.substring(F.element_at(parts, 1), 1, 1))


def xml_tag(text: Column, tag: str) -> Column:
    """Content of the first element of a name."""
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
