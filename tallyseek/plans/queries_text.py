"""Text cleaning and corpus statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyseek.functions import text as tx
from tallyseek.functions.lexicon import NUMBER_WORDS, Lexicon, century_phrases
from tallyseek.operators import corpus_stats as cs
from tallyseek.operators.chunking import chunk_texts
from tallyseek.plans.facts import corpus, table
from tallyseek.plans.registry import query
from tallyseek.plans.sqltext import BLANK, chunks_sql, normal_sql, plain, quoted, tokens, words


# The words Spark removes by default for English, as the oracle needs them.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _map_tokens_sql(toks: str, table_: dict[str, str]) -> str:
    entries = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table_.items())
    return f"list_transform({toks}, lambda t: coalesce(MAP {{{entries}}}[t], t))"


EMOJI_SQL = f"[{tx.EMOJI_RANGES}]"
SPECIAL = "&#@$%^*()<>?!+-"


def _fixed(text: str) -> str:
    decoded = text
    for entity, character in tx.HTML_ENTITIES:
        decoded = f"replace({decoded}, {quoted(entity)}, {quoted(character)})"
    out = f"CASE WHEN contains({text}, '<') THEN {text} ELSE {decoded} END"
    out = f"translate({out}, {quoted(tx.CURLY_QUOTES)}, {quoted(tx.PLAIN_QUOTES)})"
    out = f"regexp_replace({out}, '\\r\\n?|[\\x{{2028}}\\x{{2029}}\\x{{85}}]', chr(10), 'g')"
    return f"regexp_replace({out}, '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\x{{FEFF}}]', '', 'g')"


def _no_tags(text: str) -> str:
    return f"regexp_replace({text}, '<[^\\n]*?>', '', 'g')"


def _no_urls(text: str) -> str:
    word = r"[^\s\x0B\x{85}\p{Z}]+"
    return f"regexp_replace({text}, 'http{word}|www{word}', '', 'g')"


def _no_special(text: str) -> str:
    return f"translate({text}, {quoted(SPECIAL)}, '')"


def _no_emoji(text: str) -> str:
    return f"regexp_replace({text}, '{EMOJI_SQL}', '', 'g')"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}', ' ', 'g'))"


def clean_sql(text: str, stop_words=("",)) -> str:
    base = plain(_no_emoji(_no_special(_no_urls(_no_tags(_fixed(text))))))
    toks = _map_tokens_sql(_map_tokens_sql(tokens(base), century_phrases()), NUMBER_WORDS)
    toks = tokens(f"array_to_string({toks}, ' ')")
    listed = ", ".join(quoted(w) for w in sorted(stop_words))
    return f"array_to_string(list_filter({toks}, lambda t: t NOT IN ({listed})), ' ')"


@query(
    "clean_text",
    f"SELECT doc_id AS chunk_id, {clean_sql('text', ENGLISH_STOP_WORDS)} AS clean FROM documents",
)
def clean_text(spark, folder):
    """The full cleaning chain over every document."""
    lexicon = Lexicon().with_stop_words(ENGLISH_STOP_WORDS)
    return corpus(spark, folder).select(
        "chunk_id", tx.clean_for_embedding(F.col("content"), lexicon).alias("clean")
    )


@query(
    "strip_html",
    f"SELECT page_id, {_collapsed(_no_urls(_no_tags('html')))} AS body FROM pages",
)
def strip_html(spark, folder):
    body = tx.collapse_spaces(tx.strip_urls(tx.strip_html_tags(F.col("html"))))
    return table(spark, folder, "pages").select("page_id", body.alias("body"))


@query(
    "cleaning_steps",
    f"""SELECT conv_id, turn, {_fixed("text")} AS fixed, {_no_special("text")} AS no_special,
  {_no_emoji("text")} AS no_emoji, {plain("text")} AS no_punctuation,
  array_to_string({_map_tokens_sql(tokens("lower(text)"), century_phrases())}, ' ') AS centuries,
  array_to_string({_map_tokens_sql(tokens("text"), NUMBER_WORDS)}, ' ') AS digits,
  {_collapsed("text")} AS collapsed,
  CAST(len({tokens("text")}) AS INTEGER) AS blank_tokens,
  CAST(len({words("text")}) AS INTEGER) AS word_tokens,
  CAST(length(text) AS INTEGER) AS characters, substr(text, 1, 512) AS head
FROM conversations""",
)
def cleaning_steps(spark, folder):
    """Every scalar of the chain on its own."""
    text = F.col("text")
    lexicon = Lexicon()
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        tx.fix_encoding(text).alias("fixed"),
        tx.strip_special_characters(text).alias("no_special"),
        tx.strip_emoji(text).alias("no_emoji"),
        tx.strip_punctuation(text).alias("no_punctuation"),
        tx.expand_centuries(text, lexicon).alias("centuries"),
        tx.number_words_to_digits(text, lexicon).alias("digits"),
        tx.collapse_spaces(text).alias("collapsed"),
        F.size(tx.whitespace_tokens(text)).alias("blank_tokens"),
        F.size(tx.word_tokens(text)).alias("word_tokens"),
        tx.character_length(text).alias("characters"),
        tx.truncate(text, 512).alias("head"),
    )


@query(
    "word_frequency_top30",
    f"""SELECT word, count(*) AS frequency
FROM (SELECT unnest({tokens("text")}) AS word FROM documents)
GROUP BY word ORDER BY frequency DESC, word LIMIT 30""",
)
def word_frequency_top30(spark, folder):
    return cs.top_words(cs.word_frequency(corpus(spark, folder)), 30)


@query(
    "word_range_0_25",
    f"""SELECT word, count(*) AS frequency
FROM (SELECT unnest({tokens(plain("text"))}) AS word FROM documents)
GROUP BY word ORDER BY frequency DESC, word LIMIT 25""",
)
def word_range(spark, folder):
    """The charted slice of the top list, over punctuation-free text."""
    docs = corpus(spark, folder).select(tx.strip_punctuation(F.col("content")).alias("content"))
    return cs.word_range(cs.top_words(cs.word_frequency(docs), 30), 0, 25)


@query(
    "length_summary",
    """SELECT count(*) AS count, round(avg(length(text)), 6) AS mean,
  round(stddev_samp(length(text)), 6) AS std, CAST(min(length(text)) AS INTEGER) AS min,
  quantile_cont(length(text), 0.25) AS q25, quantile_cont(length(text), 0.5) AS q50,
  quantile_cont(length(text), 0.75) AS q75, CAST(max(length(text)) AS INTEGER) AS max
FROM documents""",
)
def length_summary(spark, folder):
    summary = cs.length_summary(corpus(spark, folder))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "length_histogram_50",
    """WITH b AS (SELECT min(length(text)) AS lo, max(length(text)) - min(length(text)) AS w
  FROM documents),
c AS (SELECT least((length(text) - lo) * 50 // w, 49) AS bin, count(*) AS n
  FROM documents, b GROUP BY 1)
SELECT r.range AS bin, round(lo + w * r.range / 50, 6) AS low,
  round(lo + w * (r.range + 1) / 50, 6) AS high, coalesce(n, 0) AS texts
FROM range(50) r CROSS JOIN b LEFT JOIN c ON c.bin = r.range""",
)
def length_histogram(spark, folder):
    bins = cs.length_histogram(corpus(spark, folder), 50)
    return bins.withColumns({c: F.round(c, 6) for c in ("low", "high")})


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "Year", "Month", "Day"]


def _correlation_sql() -> str:
    cells = ", ".join(
        f"{{'left_column': {quoted(a)}, 'right_column': {quoted(b)},"
        f" 'correlation': round(corr({a}, {b}), 6)}}"
        for a in CORRELATED
        for b in CORRELATED
    )
    return f"""SELECT unnest([{cells}], recursive := true) FROM (SELECT *,
  year(l_shipdate) AS Year, month(l_shipdate) AS Month, day(l_shipdate) AS Day FROM lineitem)"""


@query("correlation_matrix", _correlation_sql())
def correlation_matrix(spark, folder):
    lines = table(spark, folder, "lineitem").withColumns(
        {
            "Year": F.year("l_shipdate"),
            "Month": F.month("l_shipdate"),
            "Day": F.dayofmonth("l_shipdate"),
        }
    )
    matrix = cs.correlation_matrix(lines, CORRELATED)
    return matrix.withColumn("correlation", F.round("correlation", 6))


# Ukrainian phrases by part size, with what the chain leaves of them.
PHRASES = (
    ("у XIX столітті", "у 19 століття столітті"),
    ("два мільйони кілограмів", "2 мільйони кг"),
    ("Росія і Європа нині", "рф і єс сьогодні"),
    ("сорок тисяч років", "40 1000 рік"),
    ("українська вулиця", "укр вул"),
)


@query(
    "ukrainian_words",
    "SELECT p_partkey, CASE p_size % 5 "
    + " ".join(f"WHEN {i} THEN {quoted(clean)}" for i, (_, clean) in enumerate(PHRASES))
    + " END || ' ' || lower(replace(p_brand, '#', '')) AS clean FROM part",
)
def ukrainian_words(spark, folder):
    """Centuries, number words and word forms, each met by some part's text."""
    raw = F.array(*[F.lit(text) for text, _ in PHRASES])
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    text = F.concat_ws(" ", F.get(raw, F.col("p_size") % len(PHRASES)), brand)
    return table(spark, folder, "part").select(
        "p_partkey", tx.clean_for_embedding(text).alias("clean")
    )


@query(
    "noisy_sales",
    f"""SELECT o_orderkey, round(o_totalprice * (1 + 0.14 * {normal_sql("o_orderkey", 42)}), 2) AS noisy
FROM orders""",
)
def noisy_sales(spark, folder):
    """Multiplicative noise keyed by the row, order by order."""
    orders = table(spark, folder, "orders")
    noisy = cs.with_multiplicative_noise(
        orders.withColumn("noisy", F.col("o_totalprice")), "noisy", F.col("o_orderkey")
    )
    return noisy.select("o_orderkey", F.round("noisy", 2).alias("noisy"))


@query("chunk_documents", chunks_sql("SELECT doc_id::VARCHAR AS source, text AS content FROM documents"))
def chunk_documents(spark, folder):
    """Every document cut into overlapping chunks."""
    texts = corpus(spark, folder).select(
        F.col("chunk_id").cast("string").alias("source"), "content"
    )
    return chunk_texts(texts)
