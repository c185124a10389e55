"""The registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseek.llm import (
    common, covering, decontamination, exact_dedup, language_id, mixing, near_dedup, passages, quality, runs, secrets, spelling,
    suffix_dedup, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document; grades 0 poor, 1 fair but toxic, 2 good, learned from rated rows with crc32 mod 5 not 0."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    grades = labels.groupBy("doc_id").agg(F.max(F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    learn = common.crc_part("doc_id", 5) != 0
    rated = common.numbered(docs).filter(learn).join(grades, "doc_id")
    model = quality.fit_quality(rated.select("doc_id", "text", "grade", "_number"))
    held = docs.withColumn("held_out", ~learn)
    return quality.score_quality(held, model, ["doc_id", "held_out"])


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat nearly in another document, with both places."""
    return passages.near_passages(common.table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(common.table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the place."""
    return decontamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    learn = common.crc_part("doc_id", 5) != 0
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = common.numbered(docs).filter(learn).join(marks, "doc_id")
    model = toxicity.fit_grammar(labelled.select("doc_id", "text", "toxic", "_number"))
    return toxicity.score_toxicity(docs.withColumn("held_out", ~learn), model, ["doc_id", "held_out"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    learn = common.crc_part("doc_id", 3) != 1
    model = language_id.fit_backoff(docs.filter(learn))
    return language_id.identify(docs.withColumn("held_out", ~learn), model, ["doc_id", "held_out"])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers of rows of a stored table are the same at every read.
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return near_dedup.near_dedup(docs, row_col="_row").drop("row")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents")).drop("row")


# A finding is labelled by what issuers of keys publish about their shape.
KNOWN_SECRET = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|password=[0-9a-f]{12,}|[0-9a-f]{40})$"


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document; labels for training come from published key shapes."""
    docs = common.table(spark, sf_dir, "documents")
    found = common.stored(secrets.candidates(docs, secrets.fit_context(docs)))
    shape = F.col("candidate").rlike(KNOWN_SECRET) & (
        ~F.col("candidate").rlike("^[0-9a-f]{40}$") | F.col("before").rlike("(?i)(token|secret|key)\\s*[=:]\\s*[\"']?$")
    )
    forest = secrets.fit_forest(found.withColumn("label", shape.cast("int")))
    return secrets.scan_secrets(found, forest).select("doc_id", "start", "end", "candidate", "probability", "secret")


def with_planted_run(docs: DataFrame) -> DataFrame:
    """`text` with the words of every tenth document (by h = crc32 of the id as text) from place a on repeating with period p.

    A null id plants nothing.  Words are cut out and repeated as slices, never one lookup per word.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(common.text_or_empty(), F.lit(common.WORD), F.lit(0))
    given = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    given = given.withColumn("n", F.size("words"))
    given = given.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    given = given.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), rest), " ")
    return given.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the planted ones included, as digests, with the longest one in full."""
    found = runs.periodic_runs(with_planted_run(common.table(spark, sf_dir, "documents")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("left"), (-r["period"]).alias("brief"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.left")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.brief")).alias("period"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return best.withColumn("exponent_milli", F.floor(F.col("length") * 1000 / F.col("period")))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_components(common.table(spark, sf_dir, "documents"))


def misspelt(doc_id: int | None, run: bytes) -> bytes:
    """A run whose crc32 with the document's id is divisible by 97 loses one code point; a null id reads as the empty text."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, run))
    if h % 97:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their frequent near word, misspelt runs included."""
    counts = spelling.word_counts(common.table(spark, sf_dir, "documents"), alter=misspelt)
    return spelling.spelling_variants(counts)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_passages": op3_passages,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_spelling": op13_spelling,
}

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), lv AS (
  SELECT 0 AS i, 1.5 * sum(source_size) / sum(weight) AS level FROM s
  UNION ALL
  SELECT lv.i + 1,
         (1.5 * (SELECT sum(source_size) FROM s)
          - sum(CASE WHEN weight * level <= 2.0 * source_size THEN 0.0 ELSE 2.0 * source_size END))
         / sum(CASE WHEN weight * level <= 2.0 * source_size THEN weight END)
  FROM lv, s WHERE lv.i < 60 GROUP BY lv.i, lv.level
), t AS (
  SELECT source, source_size,
         least(weight * (SELECT level FROM lv ORDER BY i DESC LIMIT 1), 2.0 * source_size)::DOUBLE AS target
  FROM s
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM w
), o AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - upto + size)) AS taken
FROM o
"""

OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""

def _crc_step() -> str:
    """SQL for one byte b of a crc32 c: the table's entry is what the low byte's bits add, each by itself."""
    step = "c >> 8"
    for k in range(8):
        step = f"xor({step}, (xor(c, b) >> {k} & 1) * {zlib.crc32(bytes([1 << k])) ^ zlib.crc32(bytes(1))})"
    return step


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), plain AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2
), hashed AS (
  SELECT run, n, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
             lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(ch) - 64 AS BIGINT)] END))),
           lambda c, b: CRC_STEP) AS inverted
  FROM plain
), spelt AS (
  SELECT CASE WHEN xor(inverted, 4294967295) % 97 <> 0 THEN run
              ELSE left(run, CAST(xor(inverted, 4294967295) % length(run) AS INT)) || substr(run, CAST(xor(inverted, 4294967295) % length(run) AS INT) + 2)
         END AS word, n
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, i, left(word, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM cut a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM cut a JOIN words w ON a.rest = w.word
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS place
  FROM near JOIN words o ON o.word = other
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT chain.word, f.form FROM chain JOIN forms f ON f.word = chain.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.at AND l.form IS NULL
""".replace("CRC_STEP", _crc_step())

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op13_spelling": OP13_SQL}
