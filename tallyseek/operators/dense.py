"""Embedding tables and exact nearest-vector search.

A question must meet every vector, but pairs are never rows: a task multiplies one Arrow
batch of vectors by a block of questions and keeps k hits per question, so the search
sends `tasks x questions x k` rows whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseek.functions.text import clean_for_embedding, word_tokens
from tallyseek.operators.ranking import RANK_DECIMALS, top_k

Encoder = Callable[[list[str]], np.ndarray]

# Questions held as one matrix in every task; more are spread over a grid of cells.
QUESTION_BLOCK = 4096
# Blocks of questions in a grid cell: every vector travels once for each such cell.
GRID_BLOCKS = 4
# Vectors per grid cell: bounds a task's memory on the grid path.
CELL_VECTORS = 50_000
# Scores held at once: bounds the score matrix of a task.
SLICE_SCORES = 4_000_000


def embed(
    chunks: DataFrame,
    make_encoder: Callable[[], Encoder],
    column: str = "content",
    batch_size: int = 16,
) -> DataFrame:
    """Add `embedding`, computed by a user-supplied encoder loaded once per task."""
    schema = T.StructType(
        [field for field in chunks.schema]
        + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in batches:
            texts = frame[column].tolist()
            vectors = [
                vector
                for start in range(0, len(texts), batch_size)
                for vector in np.asarray(encoder(texts[start : start + batch_size]), dtype="float32")
            ]
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    return chunks.mapInPandas(encode, schema)


def embed_cleaned(
    chunks: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = 8
) -> DataFrame:
    """Drop nulls, clean, embed: the ingest step of a chunk table."""
    cleaned = chunks.filter(F.col("content").isNotNull()).withColumn(
        "clean", clean_for_embedding(F.col("content"))
    )
    return embed(cleaned, make_encoder, "clean", batch_size)


def hashed_embedding(
    texts: DataFrame, key: str, text: Column, dimensions: int = 64
) -> DataFrame:
    """`key, embedding`: word counts folded into `dimensions` buckets.

    A model-free, deterministic encoder for places without a neural one.  A text's words are counted in its row, each
    different word of a batch is hashed once, and texts stay where they are read.
    """
    from tallyseek.operators.scan import hashed_counts

    return _summed(hashed_counts(texts, key, word_tokens(text), dimensions), key, dimensions)


def hashed_bag_embedding(bags: DataFrame, dimensions: int = 64) -> DataFrame:
    """`hashed_embedding` of chunks whose words are counted already (`scan.term_bags` by `word_tokens`): no text is cut again."""
    from tallyseek.operators.scan import hashed_bag_counts

    return _summed(hashed_bag_counts(bags, dimensions), "chunk_id", dimensions)


def _summed(counted: DataFrame, key: str, dimensions: int) -> DataFrame:
    sums = [F.sum(F.col("counts")[i]).cast("float") for i in range(dimensions)]
    return counted.groupBy(key).agg(F.array(*sums).alias("embedding"))


def nearest(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = 3,
    block: int = QUESTION_BLOCK,
    cell_vectors: int = CELL_VECTORS,
    exclude_same_id: bool = False,
) -> DataFrame:
    """`query_id, chunk_id, score, rank`: the k vectors of highest cosine per question.

    `vectors`: `chunk_id, embedding`; `questions`: `query_id, embedding`.  Vectors without
    length have no cosine and are left out.  `exclude_same_id` skips the vector whose id is
    the question's own.
    """
    left = vectors.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    right = questions.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    schema = T.StructType(
        [
            T.StructField("query_id", right.schema["query_id"].dataType),
            T.StructField("chunk_id", left.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    held = right.limit(block + 1).toPandas()
    if len(held) <= block:
        hits = left.mapInPandas(_scan_with(held, k, exclude_same_id), schema)
    else:
        hits = _grid_search(left, right, k, block, cell_vectors, exclude_same_id, schema)
    return top_k(hits, k)


def _unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors and the positions of the rows that have a length."""
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.flatnonzero(norms > 0)
    return matrix[usable] / norms[usable, None], usable


def best_cells(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k best rows per column; ties go to the smaller id."""
    rounded = np.round(scores, RANK_DECIMALS)
    rows, columns = rounded.shape
    if rows <= k:
        return np.repeat(np.arange(rows), columns), np.tile(np.arange(columns), rows)
    floor = np.partition(rounded, rows - k, axis=0)[rows - k]
    row_at, column_at = np.nonzero(rounded >= floor)
    keep = _first_k(column_at, rounded[row_at, column_at], ids[row_at], k)
    return row_at[keep], column_at[keep]


def _first_k(column_at: np.ndarray, rounded: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of every column, by column; ties go to the smaller id."""
    order = np.lexsort((ids, -rounded, column_at))
    at = column_at[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def _hits(
    frames: Iterable[pd.DataFrame],
    question_ids: np.ndarray,
    question_matrix: np.ndarray,
    k: int,
    exclude_same_id: bool,
) -> Iterator[pd.DataFrame]:
    """The k best vectors per question over all frames, which are read in slices of bounded score matrices."""
    rows_at_once = max(k, SLICE_SCORES // max(1, len(question_ids)))

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for vectors in frames:
            for start in range(0, len(vectors), rows_at_once):
                part = vectors.iloc[start : start + rows_at_once]
                matrix, usable = _unit_rows(part["embedding"])
                own = part["chunk_id"].to_numpy()[usable]
                grid = matrix @ question_matrix.T
                if exclude_same_id:
                    grid[own[:, None] == question_ids[None, :]] = -np.inf
                yield own, grid

    return best_so_far(parts(), question_ids, k)


def best_so_far(parts: Iterable[tuple[np.ndarray, np.ndarray]], question_ids: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """`query_id, chunk_id, score` of the k best of every question, over parts of ids and scores (a column for each question).

    The k best so far are held; later parts are only searched above the k-th, so most of their scores are compared once.
    """
    questions = len(question_ids)
    columns, ids, scores = None, None, None

    def found() -> pd.DataFrame:
        return pd.DataFrame({"query_id": question_ids[columns], "chunk_id": ids, "score": scores})

    for own, grid in parts:
        if columns is not None and own.dtype != ids.dtype:
            # A batch with null ids is of another type: nothing is converted.
            yield found()
            columns = None
        if columns is None:
            row_at, at = best_cells(grid, own, k)
            held = (at, own[row_at], grid[row_at, at])
        else:
            # Below a full column's k-th by more than the rounding nothing can enter.
            counts = np.bincount(columns, minlength=questions)
            lowest = np.full(questions, np.inf)
            np.minimum.at(lowest, columns, scores)
            floor = np.where(counts >= k, lowest - 2 * 10.0**-RANK_DECIMALS, -np.inf)
            row_at, at = np.nonzero(grid >= floor)
            held = (np.append(columns, at), np.append(ids, own[row_at]), np.append(scores, grid[row_at, at]))
        usable_scores = np.isfinite(held[2])
        columns, ids, scores = (values[usable_scores] for values in held)
        keep = _first_k(columns, np.round(scores, RANK_DECIMALS), ids, k)
        columns, ids, scores = columns[keep], ids[keep], scores[keep]
    if columns is not None:
        yield found()


def _scan_with(held: pd.DataFrame, k: int, exclude_same_id: bool):
    if len(held):
        question_matrix, usable = _unit_rows(held["embedding"])
        question_ids = held["query_id"].to_numpy()[usable]
    else:
        question_matrix, question_ids = np.zeros((0, 0)), np.zeros(0)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(question_ids):
            yield from _hits((frame for frame in batches if len(frame)), question_ids, question_matrix, k, exclude_same_id)

    return scan


def _grid_search(left, right, k, block, cell_vectors, exclude_same_id, schema) -> DataFrame:
    """Cut both sides into hash cells and let every pair of cells meet in one task.

    Both cell sizes are bounded, nothing is collected or broadcast, and ids hash evenly.  The sides may be one table, so
    no column of the one has the other's name: a cogroup of a table with itself loses the columns that both share.
    """
    vector_cells = max(1, -(-left.count() // cell_vectors))
    question_cells = max(1, -(-right.count() // (GRID_BLOCKS * block)))

    def spread(df: DataFrame, key: str, own: str, own_cells: int, other: str, other_cells: int):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_cells))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1)).cast("array<bigint>"))
        )

    def meet(vectors: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        if not len(vectors) or not len(questions):
            return empty
        matrix, usable = _unit_rows(questions["asked"])
        ids = questions["query_id"].to_numpy()[usable]
        return next(_hits([vectors], ids, matrix, k, exclude_same_id), empty) if len(ids) else empty

    spread_vectors = spread(left, "chunk_id", "vector_cell", vector_cells, "question_cell", question_cells)
    asked = right.select("query_id", F.col("embedding").alias("asked"))
    spread_questions = spread(asked, "query_id", "asked_cell", question_cells, "asked_vector_cell", vector_cells)
    return (
        spread_vectors.groupBy("vector_cell", "question_cell")
        .cogroup(spread_questions.groupBy("asked_vector_cell", "asked_cell"))
        .applyInPandas(meet, schema)
    )
