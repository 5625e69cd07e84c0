"""A training corpus from raw documents: five stages, each on what the one before it kept.

Toxic documents go, then exact copies, then near copies; the rest is mixed to target weights (a
document can be taken up to three times, or not at all) and encoded. Every stage but the last
returns the columns of documents.

Defined results: nulls in any column, empty and very long texts, ties, repeated rows and further
columns go through every stage as its operator's docstring states; an empty table gives an empty
corpus. Documents with empty texts are one group to the exact stage, are left alone by the near one
and take no words of the mix, which therefore drops or keeps them as the balance has it. What a stage
kept is stored for the next one, and dropped once that is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import op01_sentencepiece, op04_toxicity_cnn, op05_cube_mix, op06_chosen_path, op10_block_naming
from gridloom.llm.common import drop_stored, store, table

STAGES = [
    ("toxicity", op04_toxicity_cnn.stage),
    ("exact_dedup", op10_block_naming.stage),
    ("near_dedup", op06_chosen_path.stage),
    ("mix", op05_cube_mix.stage),
    ("encode", op01_sentencepiece.stage),
]

#: The classifier, the mix and the encoding have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        drop_stored(before)  # a table that was not stored here is left alone
    return STAGES[-1][1](spark, docs, sf_dir)
