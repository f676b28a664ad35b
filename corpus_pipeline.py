"""Documents to training sequences: five stages, each written and read again before the next.

quality rules -> language -> near-duplicates -> personal data -> packing. Each stage works on all that its predecessor
kept. SQL can't express compression or signatures, so ORACLE_SQL is None; the tests hold the stages against plain
versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellatlas.llm.common import documents, scratch, written
from cellatlas.llm.langid import langid_stage
from cellatlas.llm.neardup import neardup_stage
from cellatlas.llm.packing import packing_stage
from cellatlas.llm.pii import pii_stage
from cellatlas.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("language", langid_stage),
    ("near_duplicates", neardup_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run_stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What each stage gives, by its name; all but the last are written tables in the shared folder.

    What a stage wrote besides is deleted when its result is there. A caller that needs the sequences only may delete
    the other tables (inputFiles names them) after having read them.
    """
    docs, found = documents(spark, sf_dir), {}
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = found[name] = written(stage(spark, docs, sf_dir), name, keep=True)
    name, stage = STAGES[-1]
    return found | {name: stage(spark, docs, sf_dir)}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all that is kept of documents, with their token ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids.

    Null, empty and blank texts and texts without a letter go in the first two stages; long texts are read whole; of
    rows that repeat an id and a text one stays, of near-duplicates the one with the least id; ties are as the stages
    state. An empty table gives no piece. Columns that clash with an operator's own are passed through unread.
    """
    return run_stages(spark, sf_dir)[STAGES[-1][0]]
