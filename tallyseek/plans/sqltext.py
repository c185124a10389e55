"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from tallyseek.functions.text import ASCII_PUNCTUATION
from tallyseek.operators.chunking import BLANKS, CHUNK_OVERLAP, CHUNK_SIZE
from tallyseek.operators.ranking import RANK_DECIMALS

BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda t: t <> '')"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def plain(text: str) -> str:
    """ASCII punctuation gone, lower case, dashes to blanks."""
    return f"translate(lower(translate({text}, {quoted(ASCII_PUNCTUATION)}, '')), '–—', '  ')"


def normal_sql(key: str, seed: int | str) -> str:
    """The standard normal draw of `corpus_stats.keyed_normal`."""
    digest = f"md5({key}::VARCHAR || '/' || ({seed})::VARCHAR)"

    def uniform(start: int) -> str:
        return f"('0x' || substr({digest}, {start}, 12))::BIGINT::DOUBLE"

    scale = float(1 << 48)
    return (
        f"(sqrt(-2 * ln(({uniform(1)} + 1) / {scale}::DOUBLE))"
        f" * cos(2 * 3.141592653589793::DOUBLE * {uniform(13)} / {scale}::DOUBLE))"
    )


def ranked(scores: str, k: int, score: str = "gain") -> str:
    """Top k rows of a CTE by score, ties to the smaller id."""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY"
        f" round({score}, {RANK_DECIMALS}) DESC, chunk_id) AS rank FROM {scores}"
        f" QUALIFY rank <= {k}"
    )


def bm25_ctes(text: str = "text", delta: float = 1.0, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs `bm_docs`, `bm_base` and `bm_all(query_id, chunk_id, gain, score)` over all pairs."""
    return f"""
bm_docs AS (SELECT doc_id AS chunk_id, {tokens(plain(text))} AS tk FROM documents
  WHERE {plain(text)} <> ''),
bm_len AS (SELECT chunk_id, len(tk) AS dl FROM bm_docs),
bm_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bm_len),
bm_tf AS (SELECT chunk_id, term, count(*) AS tf
  FROM (SELECT chunk_id, unnest(tk) AS term FROM bm_docs) GROUP BY ALL),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY term),
bm_q AS (SELECT query_id, term, count(*) AS qtf FROM
  (SELECT item_id AS query_id, unnest({tokens(plain(text))}) AS term FROM benchmark) GROUP BY ALL),
bm_w AS (SELECT query_id, bm_q.term, qtf * ln((n + 1) / df) AS weight
  FROM bm_q JOIN bm_df USING (term), bm_n),
bm_base AS (SELECT query_id, sum(weight) * {delta} AS base FROM bm_w GROUP BY query_id),
bm_gain AS (SELECT query_id, chunk_id,
  sum(weight * tf * {k1 + 1} / ({k1} * (1 - {b} + {b} * dl / avgdl) + tf)) AS gain
  FROM bm_w JOIN bm_tf USING (term) JOIN bm_len USING (chunk_id), bm_n GROUP BY ALL),
bm_all AS (SELECT q.query_id, d.chunk_id, coalesce(gain, 0) AS gain,
  coalesce(gain, 0) + coalesce(base, 0) AS score
  FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN bm_len d
  LEFT JOIN bm_gain g ON g.query_id = q.query_id AND g.chunk_id = d.chunk_id
  LEFT JOIN bm_base b ON b.query_id = q.query_id)"""


def tfidf_ctes(text: str = "text") -> str:
    """CTEs `tf_term`, `tf_weight` and `tf_all(query_id, chunk_id, cosine)` over all pairs."""
    return f"""
tf_docs AS (SELECT doc_id AS chunk_id, {words(text)} AS tk FROM documents WHERE {text} <> ''),
tf_n AS (SELECT count(*) AS n FROM tf_docs),
tf_tf AS (SELECT chunk_id, term, count(*) AS tf
  FROM (SELECT chunk_id, unnest(tk) AS term FROM tf_docs) GROUP BY ALL),
tf_term AS (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM tf_tf GROUP BY term), tf_n),
tf_raw AS (SELECT chunk_id, term, tf * idf AS raw FROM tf_tf JOIN tf_term USING (term)),
tf_norm AS (SELECT chunk_id, sqrt(sum(raw * raw)) AS norm FROM tf_raw GROUP BY chunk_id),
tf_weight AS (SELECT chunk_id, term, raw / norm AS weight
  FROM tf_raw JOIN tf_norm USING (chunk_id)),
tf_qraw AS (SELECT query_id, q.term, qtf * idf AS raw FROM
  (SELECT query_id, term, count(*) AS qtf FROM
    (SELECT item_id AS query_id, unnest({words(text)}) AS term FROM benchmark) GROUP BY ALL) q
  JOIN tf_term USING (term)),
tf_qweight AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id))
  AS weight FROM tf_qraw),
tf_dot AS (SELECT query_id, chunk_id, sum(d.weight * q.weight) AS cosine
  FROM tf_weight d JOIN tf_qweight q USING (term) GROUP BY ALL),
tf_all AS (SELECT q.query_id, d.chunk_id, coalesce(cosine, 0) AS cosine
  FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN tf_docs d
  LEFT JOIN tf_dot t ON t.query_id = q.query_id AND t.chunk_id = d.chunk_id)"""


def hashed_ctes(dimensions: int = 64) -> str:
    """CTE `hv_all(query_id, chunk_id, cosine)`: cosines of word counts folded by MD5."""

    def folded(table: str, key: str, name: str) -> str:
        return f"""
hv_{name} AS (SELECT key, bucket, count(*) AS c FROM (
  SELECT key, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dimensions} AS bucket
  FROM (SELECT {key} AS key, unnest({words("text")}) AS word FROM {table})) GROUP BY ALL),
hv_{name}_norm AS (SELECT key, sqrt(sum(c * c)) AS norm FROM hv_{name} GROUP BY key)"""

    return f"""{folded("documents", "doc_id", "d")},{folded("benchmark", "item_id", "q")},
hv_dot AS (SELECT q.key AS query_id, d.key AS chunk_id, sum(q.c * d.c) AS dot
  FROM hv_q q JOIN hv_d d USING (bucket) GROUP BY ALL),
hv_all AS (SELECT q.key AS query_id, d.key AS chunk_id,
  coalesce(dot, 0) / (q.norm * d.norm) AS cosine
  FROM hv_q_norm q CROSS JOIN hv_d_norm d
  LEFT JOIN hv_dot t ON t.query_id = q.key AND t.chunk_id = d.key)"""


def _cut_sql(given: str, text: str, separator: str, number: str) -> str:
    """Rows of `given` with the numbered, non-empty pieces of their text; a null separator leaves the text whole."""
    return f"""SELECT * EXCLUDE (parts), i AS {number}, CASE WHEN i = 1 THEN parts[i] ELSE {separator} || parts[i] END AS piece
FROM (SELECT *, coalesce(string_split({text}, {separator}), [{text}]) AS parts FROM {given}), unnest(range(1, len(parts) + 1)) AS u(i)
WHERE i > 1 OR parts[1] <> ''"""


def chunks_sql(texts: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """Chunks of (source, content) by paragraphs, then lines, as a walk from piece to piece.

    A chunk that begins with a piece reaches the last one that ends within `size`; the next begins with the first piece that may be repeated
    before the piece that did not fit.  Both are window frames over the pieces' places; only the walk is recursive.
    """
    line = "chr(10)"
    paragraph = f"{line} || {line}"
    part = "PARTITION BY source, island ORDER BY"
    return f"""WITH RECURSIVE given AS (
  SELECT source, content, CASE WHEN contains(content, {paragraph}) THEN {paragraph} WHEN contains(content, {line}) THEN {line} END AS sep
  FROM ({texts}) WHERE content IS NOT NULL),
coarse AS ({_cut_sql("given", "content", "sep", "a")}),
refined AS (
  SELECT source, a, piece AS outer_piece, CASE WHEN length(piece) >= {size} AND length(sep) = 2 AND contains(piece, {line}) THEN {line} END AS sep
  FROM coarse),
pieces AS (
  SELECT source, piece, length(piece) AS n, length(piece) >= {size} AS whole, CASE WHEN sep IS NULL THEN 0 ELSE a END AS run,
    row_number() OVER (PARTITION BY source ORDER BY a, b) AS seq
  FROM ({_cut_sql("refined", "outer_piece", "sep", "b")})),
marked AS (
  SELECT *, coalesce(whole OR lag(whole) OVER w OR run <> lag(run) OVER w, true) AS fresh FROM pieces WINDOW w AS (PARTITION BY source ORDER BY seq)),
islands AS (
  SELECT *, sum(fresh::INT) OVER w AS island, sum(n) OVER w - n AS place FROM marked WINDOW w AS (PARTITION BY source ORDER BY seq)),
jumps AS (
  SELECT source, island, seq, piece,
    max(seq) OVER ({part} place + n RANGE BETWEEN CURRENT ROW AND {size} - n FOLLOWING) AS last,
    min(seq) OVER ({part} place RANGE BETWEEN least({overlap}, {size} - n) PRECEDING AND CURRENT ROW) AS back
  FROM islands WHERE NOT whole),
walk AS (
  SELECT source, island, min(seq) AS seq FROM jumps GROUP BY ALL
  UNION ALL
  SELECT j.source, j.island, n.back FROM walk w JOIN jumps j ON j.source = w.source AND j.seq = w.seq
  JOIN jumps n ON n.source = j.source AND n.island = j.island AND n.seq = j.last + 1),
made AS (
  SELECT w.source, w.seq, trim(string_agg(p.piece, '' ORDER BY p.seq), {quoted(BLANKS)}) AS content
  FROM walk w JOIN jumps j ON j.source = w.source AND j.seq = w.seq
  JOIN islands p ON p.source = w.source AND p.seq BETWEEN j.seq AND j.last GROUP BY ALL
  UNION ALL SELECT source, seq, piece FROM islands WHERE whole)
SELECT pos::VARCHAR AS chunk_id, source, pos, content
FROM (SELECT source, content, row_number() OVER (PARTITION BY source ORDER BY seq)::INT AS pos FROM made WHERE content <> '')"""
