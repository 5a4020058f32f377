"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens): version is the SHA-256 of the tokenizer's file and library version, digest the SHA-256 of
the normalised content (null becomes empty; nothing else may change, since every character can change the count). Documents' digests are joined to
it; what misses is encoded once per distinct digest and appended; then all documents are joined to the grown cache. Texts move once, compressed, and
only the first copy in each map task, so a group of copies costs one text per task.

Null text: 0 bytes, 0 tokens. Repeated rows each get their row. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, decompressed, shared_dir, table, utf8, write
from .tokens import piece_cache, spaced_parts, split_before_spaces, tokenizer_path

CACHE = "version string, digest binary, n_tokens long"


def version_of(tokenizer: str) -> str:
    import tokenizers

    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _first_copies(batches):
    """Leaves the text, compressed, with the first row of each digest in this task."""
    import zstandard

    z, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        data, off = utf8(b.column("text"))
        raw, digest = memoryview(data), b.column("digest").to_pylist()
        keep = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
        yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in keep], pa.binary()), pa.array([z.compress(raw[off[i] : off[i + 1]]) for i in keep], pa.binary())], ["digest", "z"])


def _encoder(tokenizer: str):
    def encode(batches):
        cache = piece_cache(tokenizer, split_before_spaces, spaced_parts)
        try:
            yield from counted(batches, cache)
        finally:
            cache.rest()

    def counted(batches, cache):
        seen = set()
        for b in batches:
            digest = b.column("digest").to_pylist()
            keep = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
            digest = [digest[i] for i in keep]
            texts = decompressed(b.column("z").take(pa.array(keep, pa.int64())))
            for i in range(0, len(texts), 256):
                n = cache.counts([t.decode("utf-8", "replace") for t in texts[i : i + 256]])
                yield pa.RecordBatch.from_arrays([pa.array(digest[i : i + 256], pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def read_cache(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # nothing was stored yet
        return None


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def encode_missing(docs: DataFrame, tokenizer: str, cache_path: str) -> None:
    """The cache at cache_path grows by the distinct texts of docs that it doesn't have."""
    version, known = version_of(tokenizer), read_cache(docs.sparkSession, cache_path)
    texts = _rows(docs).select("digest", "text").mapInArrow(_first_copies, "digest binary, z binary").repartition("digest")
    if known is not None:  # joined as the texts lie, after their one shuffle
        texts = texts.join(known.where(F.col("version") == version).select("digest"), "digest", "left_anti")
    counts = texts.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
    write(counts.select(F.lit(version).alias("version"), "digest", "n_tokens"), cache_path, "append")


def cached_counts(docs: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row, from the cache; null where it has no count."""
    stored = docs.sparkSession.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version_of(tokenizer))
    stored = stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # two writers may have missed the same text
    return _rows(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(stored, "digest", "left").drop("digest")


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row; the cache at cache_path grows by the distinct misses."""
    encode_missing(docs, tokenizer, cache_path)
    return cached_counts(docs, tokenizer, cache_path)


def op10_token_counts(spark, sf_dir: str, limit: int = 1024, parts: int = 2) -> DataFrame:
    """All documents, in parts by a hash of doc_id over one cache (in a folder of its own): the later ones encode what the cache doesn't have by then."""
    cache, docs, tokenizer = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}", table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json")
    for k in range(parts):
        encode_missing(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k), tokenizer, cache)
    counted = cached_counts(docs, tokenizer, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
