"""A training corpus from documents, in five stages.

Each stage takes all that its predecessor kept: toxic documents go, one document of each group of near
copies stays, documents that hold benchmark items go, secrets are replaced by their kind in brackets,
and what is left is packed into sequences.

Defined results: a null text is the empty text; it is toxic for no model, near nothing, contaminated by nothing and holds no secret, so
it stays null, and packs as its end token alone. Texts of any length are judged and changed whole. Where ids repeat or are null, rows are told apart by themselves in the
search for near copies, so that different texts under one id both stay, and of equal rows one does. The row of the smallest id stays, null ids last. With an empty benchmark, or without labels, nothing is dropped for it. An empty table gives an empty table of
the same columns. All columns pass through all stages but the last under their own names, also those that are called like one that an operator
makes, or differ from another in case only; a stage reads the column that is written alike, and else the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontamination, near_dedup, packing, secret_scan, toxicity
from eventloom.llm.common import Columns, Scratch, tokenizer_path


class _Rows:
    """Documents with their columns named by place: ``frame``, ``at`` (a column's name there), and ``back`` to the names they had."""

    def __init__(self, docs: DataFrame):
        self.given = Columns(docs)
        self.frame = self.given.frame

    def at(self, name: str) -> str:
        return f"c{self.given.at(name)}"

    def back(self, rows: DataFrame) -> DataFrame:
        return self.given.named(rows.select(*self.given.passing()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _Rows(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.back(toxicity.score(rows.frame, model, text=rows.at("text")).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, rows = Scratch(spark, "kept"), _Rows(docs)
    frame, id = rows.frame, rows.at("doc_id")
    if frame.groupBy(id).count().where(f"count > 1 or {id} is null").limit(1).count():
        order = (F.col(id).asc_nulls_last(), F.xxhash64(rows.at("text")))
        ordered = frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        id = "row"
        frame = scratch.save(ordered.withColumn(id, F.monotonically_increasing_id()), "rows")  # ascends with the id
    kept = near_dedup.near_duplicates(frame.select(id, rows.at("text")), id=id, text=rows.at("text"), size=5, percent=80)
    kept = scratch.save(kept.where("kept").select(id), "ids")
    return rows.back(frame.join(kept, id, "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _Rows(docs)
    benchmark = decontamination.models_for(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.back(decontamination.annotate(rows.frame, benchmark, text=rows.at("text")).where(F.size("matches") == 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _Rows(docs)
    text, found = rows.at("text"), secret_scan.scan(rows.frame, text=rows.at("text"))[0]
    found = found.withColumn(text, secret_scan.redact(F.col(text), F.col("spans")))
    if "n_chars" in docs.columns:
        n_chars, changed = rows.at("n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn(n_chars, F.when(F.size("spans") > 0, changed).otherwise(F.col(n_chars)))
    return rows.back(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Learned scores and byte-pair merges are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written, and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
