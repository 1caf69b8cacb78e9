"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own characters say so: after at least
``MIN_CHUNK`` characters, at the next place that fits ``BOUNDARY``, at the latest
after ``MAX_CHUNK``. A document's recipe is the ordered list of the 64-bit
identifiers of its chunks.

Identifiers are verified: every distinct chunk text meets all others of its
identifier once, in a dictionary that is partially deduplicated in the map tasks. If
an identifier has several texts, the chunks that carry it get the rank of their text
beside it. So two recipes are equal exactly if the texts are equal, and all later
steps move recipes instead of texts: a group of copies, however large, is found by a
partial aggregate over recipes.

Defined results: a null text counts as empty; all empty texts are equal. A null id
orders after every other id. Rows with equal ids stay apart; of equal rows one stays.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanweave.llm.rows import numbered
from fanweave.session import stage

#: what normalisation deletes (fixed values): space, and 0x09 to 0x0D
WHITE_SPACE = " \t\n\x0b\x0c\r"
MIN_CHUNK = 1024
MAX_CHUNK = 8192
#: four characters that end a chunk
BOUNDARY = "[aeiou][nrst][dhlt][^aeiou]"


def normalised(text: str) -> Column:
    """The text without white space; null becomes empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for char in WHITE_SPACE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def chunks(norm: str) -> Column:
    """The consecutive chunks of a normalised text; together they are the text."""
    pattern = (
        rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 4}}}?(?:{BOUNDARY}|\z)|.{{1,{MAX_CHUNK}}}"
    )
    return F.regexp_extract_all(F.col(norm), F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column, bits: int = 64) -> Column:
    """Identifier of a chunk before verification; fewer ``bits`` force collisions in tests."""
    hashed = F.xxhash64(chunk)
    return hashed if bits == 64 else F.pmod(hashed, F.lit(1 << bits))


def _collisions(texts: DataFrame, bits: int) -> DataFrame:
    """``(chunk_hash, chunk, rank)`` of every identifier that more than one text has."""
    dictionary = (
        texts.select(F.explode(chunks("norm")).alias("chunk"))
        .select(chunk_id(F.col("chunk"), bits).alias("chunk_hash"), "chunk")
        .distinct()
    )
    # the texts of an identifier are few: equal 64-bit hashes of different texts
    return (
        dictionary.groupBy("chunk_hash")
        .agg(F.count(F.lit(1)).alias("texts"), F.collect_set(
            F.sha2(F.col("chunk"), 256)).alias("digests"))
        .filter("texts > 1")
        .select("chunk_hash", F.array_sort("digests").alias("digests"))
    )


def _repair(texts: DataFrame, recipes: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Append to the recipes the ranks of chunks whose identifier several texts share."""
    ranks = (
        texts.select("row_no", F.posexplode(chunks("norm")).alias("pos", "chunk"))
        .withColumn("chunk_hash", chunk_id(F.col("chunk"), bits))
        .join(shared, "chunk_hash")
        .select(
            "row_no", "pos",
            F.array_position("digests", F.sha2(F.col("chunk"), 256)).alias("rank"),
        )
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
        .select("row_no", F.transform("ranks", lambda r: r["rank"]).alias("ranks"))
    )
    none = F.array().cast("array<bigint>")
    return recipes.join(ranks, "row_no", "left").withColumn(
        "recipe",
        F.concat(F.array(F.size("recipe").cast("long")), "recipe", F.coalesce("ranks", none)),
    ).drop("ranks")


def exact_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", row: str | None = None,
    bits: int = 64,
) -> DataFrame:
    """One row per document with the group of its equal texts.

    Columns: ``row_no``, ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (of the normalised text). Of a group the text with the most code
    points stays, then the smallest id. ``row`` names a unique number of the rows;
    without it the rows are numbered here.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(
        number.alias("row_no"), F.col(id).alias("doc_id"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("code_points"),
        normalised(text).alias("norm"),
    )
    recipes = stage(
        texts.select(
            "row_no", "doc_id", "code_points",
            F.sha2(F.col("norm"), 256).alias("text_sha256"),
            F.transform(chunks("norm"), lambda c: chunk_id(c, bits)).alias("recipe"),
        ),
        "recipes",
    )
    shared = stage(_collisions(texts, bits), "shared-chunk-ids")
    if not shared.isEmpty():
        if row is None:
            placed, row = numbered(docs, "exact-dedup")
            return exact_duplicates(placed, id, text, row, bits)
        recipes = _repair(texts, recipes, shared, bits)
    best = F.max(
        F.struct("code_points", F.col("doc_id").isNotNull().alias("named"),
                 (-F.col("doc_id")).alias("minus_id"), (-F.col("row_no")).alias("minus_row"))
    ).alias("best")
    # written, so that a join with it is of two plain shuffles, which adaptive execution
    # splits where one recipe has very many copies, or of none if the table is small
    groups = stage(
        recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best)
        .filter("group_size > 1")
        .select("recipe", "group_size", (-F.col("best.minus_id")).alias("keep_id"),
                (-F.col("best.minus_row")).alias("keep_row")), "copy-groups")
    alone = F.col("group_size").isNull()
    return recipes.join(groups, "recipe", "left").select(
        "row_no", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they had."""
    placed, row = numbered(docs, "exact-dedup")
    dropped = exact_duplicates(placed, id, text, row).filter(~F.col("kept"))
    return placed.join(
        dropped.select(F.col("row_no").alias(row)), row, "left_anti"
    ).select(*docs.columns)
