"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

A stage keeps all of docs' columns, whatever their names: inside it they have names of their own. Nulls, empty tables and
repeated rows come out as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontamination, mixing, near_copies, token_store, toxicity
from vellumine.llm.common import OWN, scratch, table, written
from vellumine.llm.queries import TOKENIZER, TOXIC
from vellumine.session import prepare


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that clash with nothing, and their names by the old ones."""
    names = {c: f"{OWN}c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*names.values()).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The machine is fitted on labelled documents of this stage's input."""
    inner, names = _renamed(docs)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(inner, machine, keep=tuple(names.values()), text=names["text"], out=OWN + "score")
    return _restored(scored.filter(F.col(OWN + "score") < TOXIC), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id: found by op10's Golay codewords and verified,
    then what is further apart in bits by shared shingles."""
    inner, names = _renamed(docs)
    prepare(spark)
    return _restored(near_copies.without_near_copies(inner, id_col=names["doc_id"], text=names["text"]), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    inner, names = _renamed(docs)
    row = OWN + "row_of_stage"
    rows = inner.withColumn(row, F.monotonically_increasing_id())  # docs is a table that is read, so its rows keep their numbers
    with scratch(spark):
        found = decontamination.find_overlaps(rows, table(spark, sf_dir, "benchmark"), id_col=names["doc_id"], text=names["text"], keep=(row,))
        hit = written(found.filter(F.size("spans") > 0).select(row), "contaminated-rows", stays=True)
    return _restored(rows.join(hit, row, "left_anti"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""
    inner, names = _renamed(docs)
    mixed = mixing.mix(inner, quality=mixing.text_quality(F.col(names["text"])), id_col=names["doc_id"], text=names["text"], source=names["source"], carry=tuple(names.values()))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _restored(mixed.filter("copies > 0").withColumn(OWN + "time", times), names)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a token store; what it holds of each document, read back."""
    store = token_store.write_store(docs, TOKENIZER, end=0)
    return token_store.read_digests(prepare(spark), store)
