"""From raw documents to packed training sequences: five stages, each one of the training-data operators.

Every stage gets what the one before it kept, written as Parquet and read
again, and returns the columns of ``documents``; the last one returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sablework.llm.common import documents, shared_dir
from sablework.llm.exact_dedup import keep_first_copies
from sablework.llm.langid import keep_known_languages
from sablework.llm.minhash import keep_one_of_each
from sablework.llm.packing import pack_documents
from sablework.llm.pfair import mix_sources

STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Language identification, near-duplicates and packing are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    home = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
