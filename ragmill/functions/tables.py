"""Table functions for SQL: rows to many rows, with an output schema that follows from the input's."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class ChunkRows:
    """chunk_rows(TABLE(rows) PARTITION BY key ORDER BY place, text => 'text', size => 40, overlap => 10): the words of a partition's rows,
    laid end to end, in chunks of `size` of which each begins with the last `overlap` words of the one before. The last chunk is the first
    that reaches the end; a partition without words has none.

    A chunk's row has the input's other columns, from the row in which it begins, then chunk (from 0), n_words, n_rows (rows that it touches)
    and words. A partition of any length passes by: no more than a chunk is held.
    """

    ADDED = (("chunk", T.LongType()), ("n_words", T.LongType()), ("n_rows", T.LongType()), ("words", T.StringType()))

    def __init__(self) -> None:
        self.held: list[tuple[str, int]] = []  # words and the numbers of their rows
        self.rows: dict[int, list] = {}
        self.n_rows = self.n_chunks = self.fresh = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("chunk_rows takes a table")
        schema, column = table.dataType, text.value
        if column not in schema.names or not isinstance(schema[column].dataType, T.StringType):
            raise ValueError(f"no text column {column} among {', '.join(schema.names)}")
        shared = overlap.value if overlap is not None else 0
        if not 0 <= shared < size.value:
            raise ValueError("an overlap is smaller than the size")
        kept = [f for f in schema.fields if f.name != column]
        if clash := {f.name for f in kept} & {name for name, _ in ChunkRows.ADDED}:
            raise ValueError(f"columns of these names are added: {', '.join(sorted(clash))}")
        return AnalyzeResult(T.StructType([*kept, *(T.StructField(name, kind) for name, kind in ChunkRows.ADDED)]))

    def eval(self, table: Row, text: str, size: int, overlap: int = 0) -> Iterator[tuple]:
        self.overlap = overlap
        words = (table[text] or "").split()
        if words:
            self.rows[self.n_rows] = [table[c] for c in table.__fields__ if c != text]
        for word in words:
            if len(self.held) == size:
                yield self._chunk()
                self.held = self.held[size - overlap :]
                self.fresh = 0
                first = self.held[0][1] if self.held else self.n_rows
                self.rows = {i: r for i, r in self.rows.items() if i >= first}
            self.held.append((word, self.n_rows))
            self.fresh += 1
        self.n_rows += 1

    def _chunk(self) -> tuple:
        out = (*self.rows[self.held[0][1]], self.n_chunks, len(self.held), len({i for _, i in self.held}), " ".join(w for w, _ in self.held))
        self.n_chunks += 1
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.fresh:
            yield self._chunk()


def register(spark: SparkSession) -> None:
    """Make the table functions known to spark.sql."""
    spark.udtf.register("chunk_rows", udtf(ChunkRows))
