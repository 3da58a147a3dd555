"""The index of a folder's documents: built once for a session in the shared folder, and read by every query after that."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tesela.operators import index
from tesela.operators.shared import shared_folder
from tesela.sources import readers

_built: dict[tuple[str, str], str] = {}


def index_path(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> str:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        path = f"{shared_folder(spark)}/index-{uuid4().hex}"
        index.build(corpus, path)
        _built[key] = path
    return _built[key]


def index_tables(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> dict[str, DataFrame]:
    """postings, vocabulary and documents of the stored index."""
    return readers.stored_index(spark, index_path(spark, sf_dir, corpus))
