"""Text cleaning as column expressions.

Java regex notes: ``(?U)`` gives ``\\w``, ``\\b`` and ``\\s`` their Unicode meaning, ``(?d)``
makes ``\\n`` the only line end ``.`` stops at.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyseek.functions.lexicon import Lexicon
from tallyseek.operators.sizing import attach

# ASCII punctuation that the cleaning chain deletes.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Typographic quotes and their plain forms.
CURLY_QUOTES = "‘’‚‛“”„‟"
PLAIN_QUOTES = "''''\"\"\"\""

# The HTML entities decoded by `fix_encoding`; `&amp;` comes last.
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)

# Unicode blanks, and the four information separators that also end a token.
BLANKS = "(?U)[\\s\\x1C-\\x1F]+"

# Code-point ranges of pictographs, flags, dingbats, joiners and skin tones.
EMOJI_RANGES = (
    "\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B05}-\\x{2B07}\\x{2B1B}\\x{2B1C}\\x{2B50}"
    "\\x{2B55}\\x{231A}\\x{231B}\\x{2328}\\x{23CF}\\x{23E9}-\\x{23F3}\\x{23F8}-\\x{23FA}"
    "\\x{E0020}-\\x{E007F}\\x{FE0F}\\x{200D}\\x{20E3}"
)


@F.pandas_udf(StringType())
def compose_unicode(text: pd.Series) -> pd.Series:
    """NFC form; Spark has no built-in for it."""
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def fix_encoding(text: Column, compose: bool = False) -> Column:
    """Plain quotes, `\\n` line ends, decoded entities, no control characters.

    ``compose=True`` also applies NFC, at the price of one Arrow round trip; combining marks
    are rare, so only texts that hold one make a difference.
    """
    decoded = text
    for entity, character in HTML_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(character))
    # Text that already holds a tag keeps its entities: it is markup, not damaged prose.
    damaged = F.contains(text, F.lit("&")) & ~F.contains(text, F.lit("<"))
    out = F.when(damaged, decoded).otherwise(text)
    out = F.translate(out, CURLY_QUOTES, PLAIN_QUOTES)
    out = F.regexp_replace(out, "\\r\\n?|[\\x{2028}\\x{2029}\\x{85}]", "\n")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\uFEFF]", "")
    return compose_unicode(out) if compose else out


def strip_html_tags(text: Column) -> Column:
    """Delete tags; a tag broken by a line end stays."""
    return F.regexp_replace(text, "(?d)<.*?>", "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)http\\S+|www\\S+", "")


def strip_special_characters(text: Column) -> Column:
    return F.regexp_replace(text, "[&#@$%^*()<>?!+-]+", "")


def strip_emoji(text: Column) -> Column:
    # The outer range turns most characters away with one comparison.
    return F.regexp_replace(text, f"[\\x{{200D}}-\\x{{10FFFF}}&&[{EMOJI_RANGES}]]", "")


def strip_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation, lower the case, turn the remaining dashes into blanks."""
    bare = F.lower(F.regexp_replace(text, "[!-/:-@\\[-`{-~]+", ""))
    return F.regexp_replace(bare, "[–—]", " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between Unicode blanks; an empty text gives an empty array."""
    return F.array_remove(F.split(text, BLANKS), "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def _looked_up(token: Column, table: dict[str, str]) -> Column:
    """The token's entry in a word table, else the token."""
    if not table:
        return token
    literal = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    # The hash-set test comes first: a map is searched entry by entry.
    return F.when(token.isin(list(table)), F.element_at(literal, token)).otherwise(token)


def expand_centuries(text: Column, lexicon: Lexicon) -> Column:
    tokens = whitespace_tokens(F.lower(text))
    return F.array_join(
        F.transform(tokens, lambda token: _looked_up(token, lexicon.centuries)), " "
    )


def unify_word_forms(text: Column, lexicon: Lexicon) -> Column:
    """Whole-word replacement, one pattern per written form.

    Text without any first letter of the forms skips the patterns.  `text` is repeated in the
    expression, so pass a column or a lambda variable.
    """
    if not lexicon.word_forms:
        return text
    out = text
    for written, forms in lexicon.word_forms.items():
        body = "|".join(re.escape(form) for form in sorted(forms, key=len, reverse=True))
        out = F.regexp_replace(out, f"(?U)\\b(?:{body})\\b", written.replace("$", "\\$"))
    initials = sorted({form[0] for forms in lexicon.word_forms.values() for form in forms})
    any_initial = "[" + "".join(re.escape(letter) for letter in initials) + "]"
    return F.when(text.rlike(any_initial), out).otherwise(text)


def number_words_to_digits(text: Column, lexicon: Lexicon) -> Column:
    tokens = whitespace_tokens(text)
    return F.array_join(F.transform(tokens, lambda token: _looked_up(token, lexicon.numbers)), " ")


def drop_stop_words(tokens: Column, lexicon: Lexicon) -> Column:
    if not lexicon.stop_words:
        return tokens
    words = sorted(lexicon.stop_words)
    return F.filter(tokens, lambda token: ~token.isin(words))


def clean_for_embedding(
    text: Column, lexicon: Lexicon | None = None, compose: bool = False
) -> Column:
    """The full cleaning chain; the step order is part of the result.

    Word forms hold no blanks, so they are unified token by token.  A text without the first
    letter of any word form or number word has none of them and skips both steps.
    """
    lexicon = lexicon or Lexicon()
    out = fix_encoding(text, compose)
    out = strip_html_tags(out)
    out = strip_urls(out)
    out = strip_special_characters(out)
    out = strip_emoji(out)
    out = strip_punctuation(out)
    tokens = F.transform(
        whitespace_tokens(out), lambda token: _looked_up(token, lexicon.centuries)
    )

    def written(plain: Column) -> Column:
        unified = F.transform(
            whitespace_tokens(plain), lambda token: unify_word_forms(token, lexicon)
        )
        digits = F.transform(
            whitespace_tokens(F.array_join(unified, " ")),
            lambda token: _looked_up(token, lexicon.numbers),
        )
        starts = [form for forms in lexicon.word_forms.values() for form in forms]
        initials = sorted({word[0] for word in [*starts, *lexicon.numbers]})
        if not initials:
            return plain
        any_initial = "[" + "".join(re.escape(letter) for letter in initials) + "]"
        return F.when(plain.rlike(any_initial), F.array_join(digits, " ")).otherwise(plain)

    # The array holds the text for the lambda, so that no step is computed twice.
    out = F.get(F.transform(F.array(F.array_join(tokens, " ")), written), F.lit(0))
    if not lexicon.stop_words:
        return out
    return F.array_join(drop_stop_words(whitespace_tokens(out), lexicon), " ")


def lemmatize(
    chunks: DataFrame, lemmas: DataFrame, column: str = "clean", key: str = "chunk_id"
) -> DataFrame:
    """Replace each token by its `lemma` from a `token, lemma` table; others stay.

    The table is broadcast when it fits, else hot tokens are joined apart from the rest.
    """
    tokens = chunks.select(
        key, F.posexplode(whitespace_tokens(F.col(column))).alias("_at", "token")
    )
    found = attach(tokens, lemmas.select("token", "lemma"), "token")
    words = F.array_sort(
        F.collect_list(F.struct("_at", F.coalesce("lemma", "token").alias("word")))
    )
    joined = found.groupBy(key).agg(
        F.array_join(F.transform(words, lambda word: word["word"]), " ").alias("_lemmas")
    )
    return (
        chunks.join(joined, key, "left")
        .withColumn(column, F.coalesce("_lemmas", F.lit("")))
        .drop("_lemmas")
    )


def clean_for_ranking(
    chunks: DataFrame,
    lemmas: DataFrame,
    lexicon: Lexicon | None = None,
    column: str = "content",
    key: str = "chunk_id",
) -> DataFrame:
    """Add `clean`: the cleaning chain, then lemmas."""
    cleaned = chunks.withColumn("clean", clean_for_embedding(F.col(column), lexicon))
    return lemmatize(cleaned, lemmas, "clean", key)


def character_length(text: Column) -> Column:
    return F.length(text)


def truncate(text: Column, characters: int) -> Column:
    return F.substring(text, 1, characters)
