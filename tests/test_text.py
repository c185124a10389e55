from pyspark.sql import functions as F

from tallyseek.functions import text as tx
from tallyseek.functions.lexicon import NUMBER_WORDS, Lexicon, century_phrases

# Nested tags, attributes that hold text and angle-like signs, a comment, one visible word.
PAGE = """<!-- hidden remark -->
<section id="a1"><p title="never shown"><em data-note='also "hidden"'></em>
<a href="/go?x=1">Visible</a></p>
<img alt="unseen picture" src="p.png"/></section>"""


def cleaned(spark, text, lexicon=None):
    row = spark.range(1).select(tx.clean_for_embedding(F.lit(text), lexicon).alias("c")).first()
    return row.c


def test_markup_leaves_its_words(spark):
    assert cleaned(spark, PAGE) == "visible"


def test_chain_on_ukrainian_text(spark):
    lexicon = Lexicon().with_stop_words(["це", "рік", "в"])
    text = "Росія — це «росія», https://a.b/c в XXI; два роки, п'ять років: e-mail 😀"
    assert cleaned(spark, text, lexicon) == "рф «рф» 21 століття 2 роки пять email"


def test_cleaning_twice_changes_nothing(spark):
    once = cleaned(spark, PAGE + " В XIX столітті мільйон кілограмів & <b>два</b>")
    assert cleaned(spark, once) == once


def test_empty_and_missing_text(spark):
    assert cleaned(spark, "") == ""
    assert cleaned(spark, None) is None
    row = spark.range(1).select(tx.whitespace_tokens(F.lit("")).alias("t")).first()
    assert row.t == []


def test_unicode_tokens(spark):
    row = spark.range(1).select(
        tx.word_tokens(F.lit("Їжак і é ab_1 x")).alias("w"),
        tx.whitespace_tokens(F.lit(" a  b\t")).alias("t"),
        tx.strip_html_tags(F.lit("a<b\nc>d<e>f")).alias("h"),
    ).first()
    assert row.w == ["їжак", "ab_1"]
    assert row.t == ["a", "b"]
    assert row.h == "a<b\nc>df"


def test_encoding_repairs(spark):
    row = spark.range(1).select(
        tx.fix_encoding(F.lit("“a” &amp; ’b’\r\nc d\x07")).alias("a"),
        tx.fix_encoding(F.lit("<i>&amp;</i>")).alias("b"),
        tx.fix_encoding(F.lit("é"), compose=True).alias("c"),
    ).first()
    assert row.a == "\"a\" & 'b'\nc\nd"
    assert row.b == "<i>&amp;</i>"
    assert row.c == "é"


def test_tables_by_rule():
    assert century_phrases()["xxi"] == "21 століття"
    assert NUMBER_WORDS["сорок"] == "40"


def test_lemmas_join_back_in_order(spark):
    chunks = spark.createDataFrame([(1, "b a b c"), (2, "")], "chunk_id int, clean string")
    lemmas = spark.createDataFrame([("b", "B")], "token string, lemma string")
    found = {r.chunk_id: r.clean for r in tx.lemmatize(chunks, lemmas).collect()}
    assert found == {1: "B a B c", 2: ""}
