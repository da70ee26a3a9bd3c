"""Catalog enrichment and retrieval: batches, prompts, replies, documents and search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.functions.routing import is_rejected, screened_question
from martspark.operators.nearest import nearest
from martspark.operators.ranking import global_row_number

BATCH_SIZE = 10
PRODUCT_COLUMNS = ["product_id", "product_name", "department", "aisle"]
REPLY_SCHEMA = "array<struct<id: int, description: string>>"


class Replies(NamedTuple):
    descriptions: DataFrame
    failures: DataFrame


def enrichment_batches(pairs: DataFrame, limit: int | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Distinct products in id order, with batch number and 1-based place in the batch.

    With a limit only that many rows are numbered; without one the numbering is
    distributed.
    """
    products = pairs.select(*PRODUCT_COLUMNS).distinct()
    if limit is None:
        numbered = global_row_number(products, [F.col(c) for c in PRODUCT_COLUMNS], "_n")
    else:
        first = products.orderBy(*PRODUCT_COLUMNS).limit(limit)
        numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(*PRODUCT_COLUMNS)))
    return numbered.select(
        F.floor((F.col("_n") - 1) / batch_size).alias("batch"),
        ((F.col("_n") - 1) % batch_size + 1).cast("int").alias("place"),
        *PRODUCT_COLUMNS,
    )


def product_lines(batches: DataFrame) -> DataFrame:
    """One numbered product list per batch (a batch has at most ``batch_size`` rows)."""
    line = F.concat(
        F.col("place").cast("string"), F.lit(". Name: "), "product_name", F.lit(" | Department: "), "department",
        F.lit(" | Aisle: "), "aisle",
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("place"), line.alias("line"))))
    return batches.groupBy("batch").agg(F.array_join(F.transform(listed, lambda p: p["line"]), "\n").alias("products"))


def description_prompts(batches: DataFrame) -> DataFrame:
    """One prompt per batch that asks for a JSON array of id and description."""
    head = F.lit(
        "Write a factual two-sentence shop description for every product in this list.\n\nProducts:\n"
    )
    tail = F.lit('\n\nAnswer with a JSON array only: [{"id": 1, "description": "..."}]')
    return product_lines(batches).select("batch", F.concat(head, "products", tail).alias("prompt"))


def completed(prompts: DataFrame, client: Callable[[], Callable[[str], str]], parallel_calls: int = 8) -> DataFrame:
    """Send every prompt through a client made once per task; a failing call fills ``error``.

    The number of tasks bounds the number of calls in flight.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = client()
        for frame in frames:
            replies, errors = [], []
            for prompt in frame["prompt"]:
                try:
                    replies.append(complete(prompt))
                    errors.append(None)
                except Exception as error:  # one failed batch must not lose the others
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"batch": frame["batch"], "reply": replies, "error": errors})

    return prompts.select("batch", "prompt").repartition(parallel_calls, "batch").mapInPandas(
        call, "batch long, reply string, error string"
    )


def reply_body(reply: Column) -> Column:
    """Reply text without a surrounding code fence and its language tag."""
    text = F.trim(F.regexp_replace(reply, r"^\s+|\s+$", ""))
    fenced = F.regexp_replace(F.split_part(text, F.lit("```"), F.lit(2)), r"^json", "")
    return F.regexp_replace(F.when(text.startswith("```"), fenced).otherwise(text), r"^\s+|\s+$", "")


def parsed_replies(batches: DataFrame, replies: DataFrame) -> Replies:
    """Descriptions joined back by batch and place; batches that cannot be read, and
    items that fit no product of their batch, become failure rows."""
    body = reply_body(F.col("reply"))
    # A lone object would be read as a one-element array, so require the array itself.
    items = F.when(body.startswith("["), F.from_json(body, REPLY_SCHEMA))
    read = replies.select("batch", items.alias("items"))
    unreadable = read.filter(F.col("items").isNull()).select(
        "batch", F.lit(None).cast("int").alias("place"), F.lit("unreadable reply").alias("reason")
    )
    listed = read.select("batch", F.explode("items").alias("i")).select(
        "batch", F.col("i.id").alias("place"), F.col("i.description").alias("description")
    )
    keys = ["batch", "place"]
    unmatched = listed.join(batches.select(*keys), keys, "left_anti").select(*keys, F.lit("unknown product").alias("reason"))
    descriptions = listed.join(batches, keys).select(*PRODUCT_COLUMNS, "description")
    return Replies(descriptions, unreadable.unionByName(unmatched))


# ------------------------------------------------------------------- documents


def catalog_documents(described: DataFrame) -> DataFrame:
    """Text to index with its metadata; a missing part leaves no document."""
    text = F.concat("product_name", F.lit(" | "), "department", F.lit(" | "), "description")
    return described.select(
        F.col("product_id").cast("string").alias("id"), text.alias("document"), F.struct(*PRODUCT_COLUMNS).alias("metadata")
    )


class TextEncoder:
    """Hashed term frequencies, weighted by rarity in the corpus and normalised.

    The default encoder of the retrieval jobs; any function from a frame and a
    text column to a frame with a ``vector`` array can take its place.
    """

    def __init__(self, model: PipelineModel):
        self.model = model

    @staticmethod
    def fit(corpus: DataFrame, text: str, dimensions: int = 512) -> "TextEncoder":
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol="_unit"),
        ]
        return TextEncoder(Pipeline(stages=stages).fit(TextEncoder._input(corpus, text)))

    @staticmethod
    def _input(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))

    def __call__(self, df: DataFrame, text: str) -> DataFrame:
        encoded = self.model.transform(self._input(df, text))
        return encoded.withColumn("vector", vector_to_array(F.col("_unit"), "float32")).select(*df.columns, "vector")


def vector_table(documents: DataFrame, encoder) -> DataFrame:
    """Documents with id, embedding, text and metadata, ready to be written."""
    return encoder(documents, "document").withColumnRenamed("vector", "embedding")


def search(questions: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` closest documents of every question with cosine distance.

    ``questions`` has (query_id, vector), ``index`` is a vector table.
    """
    corpus = index.select(F.col("id").alias("item_id"), F.col("embedding").alias("vector"))
    found = nearest(questions.select("query_id", "vector"), corpus, k)
    return found.withColumnRenamed("item_id", "id").join(index.drop("embedding"), "id").select(
        "query_id", "position", "id", "document", "metadata", (1 - F.col("similarity")).alias("distance")
    )


def answer_contexts(found: DataFrame, line: Column, separator: str = "\n") -> DataFrame:
    """Per question the lines of its hits in order (at most ``k`` per question)."""
    hits = F.array_sort(F.collect_list(F.struct(F.col("position"), line.alias("line"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(hits, lambda h: h["line"]), separator).alias("context"))


def product_line() -> Column:
    return F.concat(
        F.lit("- "), F.col("metadata.product_name"), F.lit(" ("), F.col("metadata.department"), F.lit("): "), F.col("document")
    )


def screened(questions: DataFrame, text: str, max_chars: int | None = None) -> DataFrame:
    """Questions trimmed, with the flag of those that match a rejected pattern anywhere in the whole text.

    With ``max_chars`` the question is cut after the screening and ``was_cut`` says where.
    """
    whole = screened_question(F.col(text))
    flagged = questions.withColumn("question", whole).withColumn("rejected", is_rejected(F.col("question")))
    if max_chars is None:
        return flagged
    return flagged.withColumn("was_cut", F.length("question") > max_chars).withColumn(
        "question", screened_question(F.col("question"), max_chars)
    )


def index_checks(index: DataFrame, descriptions: DataFrame, found: DataFrame, k: int, min_documents: int = 100, min_length: float = 50) -> DataFrame:
    """Index size, mean description length and whether every query got exactly ``k`` hits."""
    length = descriptions.agg(F.avg(F.length("description")))
    odd = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") != k))
    return index.agg(F.count(F.lit(1)).alias("documents")).select(
        "documents", (F.col("documents") >= min_documents).alias("enough_documents"),
        length.scalar().alias("mean_length"), (length.scalar() > min_length).alias("long_enough"),
        (odd.scalar() == 0).alias("all_queries_full"),
    )
