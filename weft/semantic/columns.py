"""Embeddings and transcripts of a column, as columns of a DataFrame.

Requests hold ``batch_size`` texts, or one sound file, of one Arrow batch, so a task holds one batch and nothing is shuffled.
Results are not stored: write them before they are read twice, or the model is asked again.

Defined cases: null gives null and is not asked; an empty table gives an empty one; if the input has a column with the
output's name, an analysis error says so.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import AnalysisError
from .providers import Provider, create


def _with_column(df: DataFrame, output: str, kind: T.DataType, arrow: pa.DataType, answers) -> DataFrame:
    """``df`` with ``answers(batch)``, a list, as its last column."""
    if output.lower() in (c.lower() for c in df.columns):
        raise AnalysisError(f"there is a column {output!r} already")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers(b), arrow)], [*b.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, kind)]))


def embeddings(df: DataFrame, column: str, output: str, provider: str | Provider, model: str, batch_size: int = 256) -> DataFrame:
    """``df`` with a vector for each text of ``column``."""
    client = create(provider) if isinstance(provider, str) else provider
    at = df.columns.index(column)

    def answers(b: pa.RecordBatch) -> list:
        texts = b.column(at).to_pylist()
        asked = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        for k in range(0, len(asked), batch_size):
            some = asked[k : k + batch_size]
            for i, v in zip(some, client.embed([texts[i] for i in some], model)[0]):
                out[i] = v
        return out

    return _with_column(df, output, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), answers)


def transcripts(df: DataFrame, column: str, output: str, provider: str | Provider, model: str, file_name: str = "audio.wav") -> DataFrame:
    """``df`` with the transcript of each sound file (binary) of ``column``; a map step then reads it like any text."""
    client = create(provider) if isinstance(provider, str) else provider
    at = df.columns.index(column)

    def answers(b: pa.RecordBatch) -> list:
        return [None if x is None else client.transcribe(x, file_name, model)[0] for x in b.column(at).to_pylist()]

    return _with_column(df, output, T.StringType(), pa.string(), answers)
