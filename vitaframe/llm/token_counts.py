"""Operator 2, token counts with the whole-token shortcut.

Once per job the driver proves which vocabulary strings encode alone as one
token. A pre-token of that set counts one; only the others are merged, each
distinct one once per worker for as long as its cache holds it.

Defined results: a null or empty text has no bytes and no tokens; ids, null or
repeated, are passed through row by row; special tokens' strings inside texts
count as one token, as the library does by default; texts are taken whole and
without truncation; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune
from .wordbpe import default_path, vocabulary

LIMIT = 2048
#: Merged pre-tokens that a worker remembers.
CACHE = 300_000


class _Counts(dict):
    """Tokens of each pre-token: 1 for whole ones, merged on the first need for the others."""

    def __init__(self, path: str, whole: set[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.vocabulary, self.whole = vocabulary(path), whole

    def __missing__(self, word: str) -> int:
        n = len(self.vocabulary.encode(word))
        if len(self) > len(self.whole) + CACHE:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[word] = n
        return n


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    path = path or default_path()
    tune(docs.sparkSession)
    # bounded by the vocabulary file, whatever the corpus
    whole = docs.sparkSession.sparkContext.broadcast(vocabulary(path).whole())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(path, whole.value)
        split, of = counts.vocabulary.pretokens, counts.__getitem__
        for batch in batches:
            n = [sum(map(of, split(t.as_py()))) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with the 49k word vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
