"""Token counts with a digest cache.

A count is stored under the digests of the normalised content and of the tokenizer (its
file and the library's version). Documents are joined to the stored counts by digest; of
the contents that miss, one copy each is encoded, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm.common import materialise, text_of, tidy

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Words whose counts a worker keeps, and bytes of the longest of them; others are encoded again when they come.
KEPT_WORDS, LONG_WORD = 400_000, 256
#: A content is hot with more than this share of the rows and more rows than that; there are at most as many.
HOT_SHARE, HOT_LEAST = 2048, 200


def collapsed(column: str = "text"):
    """The text with every run of ASCII white space as one space, trimmed.

    For a tokenizer that drops white space this keeps the count; others want ``text_of``.
    """
    return F.trim(F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]++", " "))


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def count_words_of(path: str):
    """mapInArrow function: (content, text) to (content, n_tokens).

    For tokenizers that split at white space and drop it. Tokens never span white space, so
    a text's count is the sum over its words, and a worker encodes each word it meets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, known = Tokenizer.from_file(path), {}
        for batch in batches:
            counts = []
            for value in batch.column(1).cast(pa.binary()):
                words = value.as_py().split()
                missing = [w for w in dict.fromkeys(words) if w not in known]
                if missing:
                    if len(known) > KEPT_WORDS:
                        known = dict(list(known.items())[: KEPT_WORDS // 2])
                        missing = [w for w in dict.fromkeys(words) if w not in known]
                    encoded = tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
                    known.update(zip(missing, map(len, encoded), strict=True))
                counts.append(sum(map(known.__getitem__, words)))
                for w in missing:
                    if len(w) > LONG_WORD:
                        del known[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def cached_counts(df: DataFrame, tokenizer_path: str, cache_path: str, content=None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; the cache at ``cache_path`` grows by the misses.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and equal texts share one
    cache entry; texts of any length are counted whole. An empty table gives an empty result
    and leaves the cache as it is. Other columns are not read, whatever their names.
    """
    spark, version = df.sparkSession, tokenizer_digest(tokenizer_path)
    content = collapsed(text_col) if content is None else content
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)  # so that it can be read
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    keyed = materialise(
        df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("content")),
        "token-digests",
    )
    texts = df.select(digest.alias("content"), content.alias("text"))
    misses = texts.join(stored.select("content"), "content", "left_anti").dropDuplicates(["content"])
    counted = misses.mapInArrow(tidy(count_words_of(tokenizer_path)), "content binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    counts = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have appended the same
    # contents of very many rows are joined where the rows lie
    hot_rows = max(HOT_LEAST, keyed.count() // HOT_SHARE)
    hot = F.broadcast(materialise(keyed.groupBy("content").count().filter(F.col("count") > hot_rows).select("content"), "token-hot"))  # at most HOT_SHARE rows
    rare = keyed.join(hot, "content", "left_anti").join(counts, "content")
    common = keyed.join(hot, "content", "left_semi").join(F.broadcast(counts.join(hot, "content", "left_semi")), "content")
    return rare.union(common).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
