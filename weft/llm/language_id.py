"""Language identification with a blended-spectrum string kernel.

A text is the set of its distinct 1-, 2- and 3-grams of code points, lower-cased (presence, hashed to ``WIDTH`` cells);
the kernel is the number of shared cells over the geometric mean of both counts. Landmark texts give a Nystrom map, on
which one-versus-rest kernel ridge regression is solved. As the kernel is linear in the presence vector, landmarks, map
and ridge weights fold into one WIDTH x languages matrix, and a batch of texts is scored by one matrix product.

Bounds: at most ``ROWS_PER_LANGUAGE`` labelled texts of each language (most zeros at the head of the id's hash first) are learned from,
``LANDMARKS`` of them are landmarks; their presence bits (WIDTH / 8 bytes each) are all that reaches the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language, without an id or
without a letter are not learned from; if nothing can be learned every text is ``und``; long texts are read whole; rows that
repeat an id and language are one row of the sample and are all learned from; if the input has a column with the result's name,
the result's gets an underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name
from .textscan import buffers, chunks

WIDTH = 1 << 15
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 400
LANDMARKS = 64
RIDGE = 1e-3
UNKNOWN = "und"
_TEXTS = 128  # in one matrix product


def presence(column: pa.Array):
    """(index of the first text, texts x WIDTH matrix of 0 and 1) in runs of texts."""
    column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        for at in range(a, b, _TEXTS):
            to = min(b, at + _TEXTS)
            yield at, _cells(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def _cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n * WIDTH, np.uint8)
    if len(data):
        starts = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.uint32), np.diff(starts[offsets]))
        if len(doc) != len(codes):  # undecodable bytes: one text after the other
            parts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(n)]
            codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
            doc = np.repeat(np.arange(n, dtype=np.uint32), [len(p) for p in parts])
        base = doc * np.uint32(WIDTH)
        gram = np.zeros(len(codes), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            m = len(codes) - k + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(0x01000193) + codes[k - 1 :] * np.uint32(0x9E3779B1) + np.uint32(k)
            if k in ORDERS:
                cell = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                inside = doc[k - 1 :] == doc[:m]
                out[(base[:m] + (cell >> np.uint32(17)))[inside]] = 1
    return out.reshape(n, WIDTH)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # WIDTH x languages
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.fill_null("") if column.null_count else column
        letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        names, scores = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if self.languages:
            for at, x in presence(texts):
                size = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64))).astype(np.float32)
                f = (x.astype(np.float32) @ self.weights) / size[:, None] + self.bias
                best = f.argmax(axis=1)
                names[at : at + len(x)] = np.array(self.languages, object)[best]
                scores[at : at + len(x)] = np.clip((f[np.arange(len(x)), best] + 1) / 2, 0, 1)
        names[~letter], scores[~letter] = UNKNOWN, 0.0
        return names.tolist(), scores


def fit(rows: np.ndarray, names: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From presence rows and their languages."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    x = rows.astype(np.float32)
    x /= np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
    each = {n: [i for i, m in enumerate(names) if m == n] for n in languages}
    marks = x[[i for n in languages for i in each[n][:landmarks]]]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(x @ marks.T) @ root, np.ones((len(x), 1))], axis=1)
    y = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    damp = ridge * len(x) * np.eye(phi.shape[1])
    damp[-1, -1] = 0
    w = np.linalg.solve(phi.T @ phi + damp, phi.T @ y)
    return Model(languages, (marks.T @ (root @ w[:-1])).astype(np.float32), w[-1].astype(np.float32))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    known = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"))
    # zeros at the head of the id's hash: half of the rows have one at least, a quarter two, ..; for each language the
    # largest number that leaves enough rows, so that whatever its share few more than ``rows`` are ranked in one task
    known = known.withColumn("zeros", F.length(F.regexp_extract(F.lpad(F.bin(F.xxhash64("id")), 64, "0"), "^0*", 0)))
    sizes = known.groupBy("lang", "zeros").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("zeros"))))
    least = sizes.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= rows, F.col("zeros"))), F.lit(0)).alias("least"))
    # a row for each language, as the model has a column for each
    few = known.join(F.broadcast(least), "lang").where(F.col("zeros") >= F.col("least")).distinct()
    order = Window.partitionBy("lang").orderBy(F.desc("zeros"), F.xxhash64("id"), "id")
    sample = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("id", "lang")

    def bits(batches):
        for b in batches:
            found = [np.packbits(r).tobytes() for _, x in presence(b.column("text")) for r in x]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(found, pa.binary())], ["id", "lang", "bits"])

    texts = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    got = texts.join(F.broadcast(sample), ["id", "lang"]).select("id", "lang", "text").mapInArrow(bits, "id long, lang string, bits binary").collect()
    got.sort(key=lambda r: (hash_order(r["id"]), r["bits"]))
    x = np.array([np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)) for r in got]) if got else np.zeros((0, WIDTH), np.uint8)
    return fit(x, [r["lang"] for r in got])


def hash_order(i: int) -> int:
    """An order without regard to how ids were given out."""
    return (i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def identify(docs: DataFrame, model: Model, text: str = "text", column: str = "language") -> DataFrame:
    """``docs`` with a struct of ``lang`` and ``score``."""
    column = free_name(docs.columns, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(pa.array(texts, pa.string(), from_pandas=True))
        return pd.DataFrame({"lang": names, "score": scores})

    return docs.withColumn(column, run(F.col(text)))
