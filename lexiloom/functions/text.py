"""Cleaning and tokenising as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept and removed by the cleaning rules. Letters are spelled out
# because a class of single characters is one bit set; a class of ranges is a chain of
# predicates that Java 17 threads slow each other down on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
KEYWORD_DROP = rf"[^ \-{ascii_lowercase}\x{{3163}}]+"  # of lower-cased text
DELIMITERS = r"[ .,\t]"
HANGUL = "ㄱ-ㅎㅏ-ㅣ가-힣"
LATIN = ascii_uppercase + ascii_lowercase

# English sentence rules, applied in this order (pattern, replacement).
ENGLISH_RULES = [
    (rf"[^{ascii_uppercase}{ascii_lowercase}{digits}(),!?'`]", " "),
    (r"'s", " 's"),
    (r"'ve", " 've"),
    (r"n't", " n't"),
    (r"'re", " 're"),
    (r"'d", " 'd"),
    (r"'ll", " 'll"),
    (r",", " , "),
    (r"!", " ! "),
    (r"\(", r" \( "),
    (r"\)", r" \) "),
    (r"\?", r" \? "),
    (r"\s{2,}", " "),
]

Tokenizer = Callable[[Column], Column]


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_keyword_text(text: Column) -> Column:
    """Lower-case and keep only space, hyphen, ASCII letters and U+3163."""
    return F.regexp_replace(F.lower(strip(text)), KEYWORD_DROP, "")


def clean_english_text(text: Column, keep_escape: bool = True) -> Column:
    """Split contractions and punctuation off words.

    ``keep_escape`` keeps the literal backslash written before brackets and question marks.
    """
    for pattern, replacement in ENGLISH_RULES:
        if not keep_escape:
            replacement = replacement.replace("\\", "")
        text = F.regexp_replace(text, pattern, replacement.replace("\\", "\\\\"))
    return strip(text)


def clean_script_text(text: Column, letters: str = HANGUL) -> Column:
    """Keep the letters of one script and the space."""
    return F.regexp_replace(text, f"[^{letters} ]", "")


def normalize_line(text: Column, trim: bool = False) -> Column:
    """Remove line feeds, optionally trim, lower-case."""
    text = F.replace(text, F.lit("\n"), F.lit(""))
    return F.lower(strip(text) if trim else text)


def tokenize_delims(text: Column, keep_empty: bool = False) -> Column:
    """Split on space, full stop, comma and tab."""
    parts = F.split(text, DELIMITERS, -1)
    return parts if keep_empty else F.array_remove(parts, "")


def tokenize_space(text: Column) -> Column:
    """Split on single spaces; empty tokens are kept."""
    return F.split(text, " ", -1)


def tokenize_words(text: Column) -> Column:
    """Runs of two or more word characters, the usual tf-idf vectoriser default."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{2,}"), F.lit(0))


def cleaned_words(clean: Column) -> Column:
    """:func:`tokenize_words` of cleaned keyword text, in which only space and hyphen part words."""
    return F.filter(F.split(clean, "[ -]", -1), lambda t: F.length(t) > 1)


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens outside a literal word list, which becomes a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def keyword_tokens(text: Column) -> Column:
    """Clean a raw line and split it into its non-empty tokens.

    Of the delimiters only the space survives cleaning, so no pattern is needed to split.
    """
    return F.array_remove(F.split(clean_keyword_text(text), " ", -1), "")


def resolve_tokenizer(tokenizer: Tokenizer | None) -> Tokenizer:
    """``None`` means single spaces; any ``Column -> Column`` function is accepted.

    A pandas UDF returning ``array<string>`` is such a function, so external analysers
    plug in here.
    """
    return tokenize_space if tokenizer is None else tokenizer


def distinct_words(csv: Column) -> Column:
    """Sorted set of the lower-cased words of a comma-separated list."""
    return F.sort_array(F.array_distinct(F.transform(F.split(csv, ",", -1), F.lower)))


def prefix_pieces(tokens: Column, mark: str = "##") -> Column:
    """Mark every token but the first of the sentence and join by space."""
    marked = F.transform(tokens, lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit(mark), t)))
    return F.concat_ws(" ", marked)


def keep_words(text: Column, tokenizer: Tokenizer, stop_words: list[str]) -> Column:
    """Comma-joined tokens of ``text`` outside a short literal stop list."""
    return F.concat_ws(",", without(tokenizer(text), stop_words))
