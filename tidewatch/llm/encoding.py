"""Problem 8: the whole corpus as token ids of a public byte-level BPE tokenizer.

Method: a distinct-word table. Texts are split into words in Spark, every distinct word is encoded once, and its ids are
joined back by position: blocks of documents meet the words that occur in them, never all words or a hot word's rows.
Decoding joins ids with their pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import BROADCAST_ROWS, materialise, parallelism

#: Bytes of words and ids of a table that is broadcast, at most.
BROADCAST_BYTES = 32_000_000
#: Folder of the vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
#: fixed value: the pattern that splits text before the merges of byte_bpe_50k
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one block, about; a task holds the word table of one block and one Arrow batch of documents.
BLOCK_DOCS = 10_000

WORDS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("word", T.StringType())])


@lru_cache(4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


def _valid(text: str) -> str:
    """Unpaired surrogates, which UTF-8 can't hold, as the replacement character."""
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _block_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split = splitter().findall
    for f in frames:
        seen: dict[int, set[str]] = {}
        for block, text in zip(f["block"].tolist(), f["text"].tolist()):
            seen.setdefault(block, set()).update(split(text))
        pairs = [(b, w) for b, words in seen.items() for w in words]
        yield pd.DataFrame(pairs, columns=["block", "word"])


def _encode_words(folder: str, name: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        enc = encoder(folder, name)
        return words.map(lambda w: enc._encode_single_piece(w.encode("utf-8")))

    return encode


def _by_position(folder: str, name: str, count_only: bool):
    """Rows of a block come as its words (kind 0), then its documents (kind 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, now, table = splitter().findall, None, {}
        for f in frames:
            out = []
            for block, kind, key, text, ids in zip(f["block"].tolist(), f["kind"].tolist(), f["key"].tolist(), f["text"].tolist(), f["ids"].tolist()):
                if block != now:
                    now, table = block, {}
                if kind == 0:
                    table[text] = len(ids) if count_only else ids.tolist()
                elif count_only:
                    out.append((key, sum(table[w] for w in split(text)) if text else 0))
                else:
                    got: list[int] = []
                    for w in split(text or ""):
                        got += table[w]
                    out.append((key, got))
            yield pd.DataFrame(out, columns=["key", "n_tokens" if count_only else "ids"])

    return run


def word_table(words: DataFrame, folder: str, name: str) -> DataFrame:
    """(word, ids) of every distinct word, materialised."""
    return materialise(words.select("word").distinct().select("word", _encode_words(folder, name)("word").alias("ids")), "words")


def _encoded(df: DataFrame, key: str, text: str, folder: str, name: str, count_only: bool) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = max(1, -(-rows.count() // BLOCK_DOCS))
    docs = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.xxhash64("key"), F.lit(0))), F.lit(blocks)).cast("int"))
    words = docs.select("block", "text").where("text <> ''").mapInPandas(_block_words, WORDS).distinct()
    words = materialise(words, "block-words")
    table = word_table(words, folder, name)
    n_words, n_bytes = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 4 * F.size("ids")), F.lit(0))).first()  # a word may be as long as a text
    small = n_words <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES
    known = words.join(F.broadcast(table) if small else table, "word")  # a word stands once in a block, so no word is hot
    none = lambda t: F.lit(None).cast(t)
    both = known.select("block", F.lit(0).alias("kind"), none(rows.schema["key"].dataType).alias("key"), F.col("word").alias("text"), "ids").unionByName(
        docs.select("block", F.lit(1).alias("kind"), "key", "text", none("array<int>").alias("ids"))
    )
    parts = max(parallelism(df.sparkSession), 1)
    result = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ordered = both.repartition(min(parts, blocks) if blocks < parts else parts, "block").sortWithinPartitions("block", "kind")
    return ordered.mapInPandas(_by_position(folder, name, count_only), result).withColumnRenamed("key", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) for every row of df. Null and empty texts have the empty list; white space is text like any other;
    strings of special tokens are ordinary text. Rows of equal keys stay separate rows; an empty df gives no rows and
    other columns are ignored. Of a key of null the row still comes out, with a null key."""
    return _encoded(df, key, text, folder, name, False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens), as encode, without moving the ids."""
    return _encoded(df, key, text, folder, name, True)


def pieces(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece) with the piece in hexadecimal; one row an id of the vocabulary."""
    enc = encoder(folder, name)
    return spark.createDataFrame([(i, enc.decode_single_token_bytes(i).hex()) for i in range(enc.n_vocab)], "id int, piece string")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): the pieces of the ids, joined in order. Null ids give null, the empty list the empty text; an id that
    the vocabulary hasn't gives null. Keys have to be unique and not null."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    spread = rows.select("key", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(df.sparkSession, folder, name)), "id", "left")  # the vocabulary is fixed
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("?")).alias("piece"))))
    joined = spread.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x.piece), "").alias("hex"))
    text = F.when(F.col("ids").isNull(), None).when(F.size("ids") == 0, "").otherwise(F.decode(F.unhex("hex"), "UTF-8"))
    return rows.join(joined, "key", "left").select(F.col("key").alias(key), text.alias("text"))
