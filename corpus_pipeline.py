"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents, whose files
then go.

Defined results: a null or empty text fails the quality rules; a null doc_id stays, one row of each text; of repeated rows
one stays; a null source is a source; columns besides doc_id, text, source, lang and n_chars are carried unread up to
packing, whatever their names; an empty table gives no rows. The stages' modules say the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import cut, free, table
from weftline.llm.jaccard import keep_first
from weftline.llm.mixing import mix_sources
from weftline.llm.packing import pack_documents
from weftline.llm.quality import keep_good
from weftline.llm.secrets import redact_secrets

STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_documents),
]

#: Token ids are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            free(before)
        before = docs
    return docs
