"""Problems 6 to 8: packing, leaked evaluation items and keyword pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.leaks import leaked_passages
from lodestone.llm.packing import pack
from lodestone.llm.stuffing import keyword_pages
from lodestone.llm.tokens import token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tokens of a container.
CAPACITY = 2048


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or those of its pieces."""
    sizes = token_counts(_documents(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("tokens").alias("units"))
    packed = pack(sizes, CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("first_unit").alias("first_token"), F.col("units").alias("tokens"), "container", "tier", "step")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/eval_item.parquet"), window=12)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leak: in how many documents, and the most places of the item that one document holds."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("windows").alias("most_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_pages(_documents(spark, sf_dir)).select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword pages per source, beside all its pages, with the mean share of repeated strings in them."""
    texts = _documents(spark, sf_dir)
    rows = texts.select("doc_id", "source").join(keyword_pages(texts), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.count("list_share").alias("keyword_pages"), F.round(F.avg("repeated_share"), 6).alias("mean_repeated")
    )


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)).replace("＇", "")
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "")
#: SQL has NFC only; of what NFKC does beyond it, the texts here need the full-width forms and the blanks.
_WORDS = f"""list_filter(string_split_regex(lower(translate(nfc_normalize(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'),
    '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g')), '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"""
_WINDOWS = f"""
item as (select item_id, {_WORDS} as w from eval_item where text is not null),
item_window as (select distinct item_id, list_slice(w, k, k + 11) as win from (select item_id, w, unnest(range(1, len(w) - 10)) as k from item)),
doc as (select doc_id, {_WORDS} as w from documents where text is not null),
doc_window as (select doc_id, list_slice(w, k, k + 11) as win from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from doc))"""
P7_SQL = f"with {_WINDOWS} select distinct doc_id, item_id from doc_window join item_window using (win)"
P7_ITEMS_SQL = f"""with {_WINDOWS}, leak as (select doc_id, item_id, count(distinct win) as windows from doc_window join item_window using (win) group by all)
select item_id, count(*) as documents, max(windows) as most_windows from leak group by item_id"""
