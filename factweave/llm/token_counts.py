"""Token counts through a digest cache.

A text's count is stored under the digest of its content and the digest of its tokenizer (file bytes
and library version). Documents are joined to the stored counts by digest; only distinct contents that are missing
are encoded, and their counts are appended to the cache.

Within a task the pieces between single spaces are counted once each: a byte-level tokenizer with the
usual word pattern never joins across a space that stands between two characters other than white space.
Texts where white space is not that plain go to the library whole.

Defined cases: null text is the empty text with 0 tokens; repeated contents are encoded once; an empty
table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import pick, shared_dir, table

LIMIT = 512
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Pieces remembered by one worker; when full it starts over.
PIECES = 600_000
#: White space other than space and line feed. Fixed values.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _odd(text: str) -> bool:
    """Whether white space is other than single spaces and line feeds between words."""
    return any(x in text for x in ("  ", " \n", "\n ", "\n\n", *OTHER_SPACE)) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()[:24]


class Counter:
    """Counts tokens as the tokenizer's library does, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
            self.t.no_truncation()
            self.t.no_padding()
            self.encode = lambda texts: [len(e) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
            # split at spaces only where merges cannot cross them
            self.by_piece = self.t.normalizer is None and "ByteLevel" in str(self.t.pre_tokenizer) and "add_prefix_space=False" in str(self.t.pre_tokenizer) and "use_regex=True" in str(self.t.pre_tokenizer)
        else:
            import sentencepiece

            self.t = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in self.t.encode(texts, num_threads=1)]
            self.by_piece = False

    def _learn(self, pieces: list[str]) -> None:
        """Count pieces that follow a space. A stop or comma after a letter is a piece of its own to the word pattern."""
        cores = {x: x[:-1] if x[-1:] in (".", ",") and "a" <= x[-2:-1].lower() <= "z" else x for x in pieces}
        new = [x for x in set(cores.values()) if x not in self.known]
        self.known.update(zip(new, self.encode([" " + x for x in new])))
        stop = {x: n for x, n in zip(".,", self.encode([".", ","]))}
        self.known.update({x: self.known[core] + stop[x[-1]] for x, core in cores.items() if core is not x})

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole = []
        for i, text in enumerate(texts):
            if not self.by_piece or _odd(text):
                whole.append(i)
                continue
            first, *rest = text.split(" ")
            pieces = set(rest)
            new = [x for x in pieces if x not in self.known]
            if new:
                if len(self.known) + 2 * len(new) > PIECES:
                    self.known.clear()
                    new = list(pieces)
                self._learn(new)
            out[i] = sum(map(self.known.__getitem__, rest)) + (self.encode([first])[0] if first else 0)
        for at in range(0, len(whole), 64):
            for i, n in zip(whole[at : at + 64], self.encode([texts[i] for i in whole[at : at + 64]])):
                out[i] = n
        return out


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if there is no cache yet. A content appended twice (a rerun) counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, content (digest), n_tokens for every row; misses are appended to the Parquet table ``cache``."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pick(docs, id_col, text_col).select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content"), text.alias("t"))
    have = stored(spark, cache).where(F.col("tokenizer") == version).select("content")
    misses = rows.select("content", "t").join(have, "content", "left_anti").dropDuplicates(["content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            column, counts = batch.column("t"), []
            for at in range(0, len(batch), 256):
                counts += counter.count(column.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([version] * len(batch), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    found = stored(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.select(id_col, "n_bytes", "content").join(found, "content", "left").select(id_col, "n_bytes", "content", "n_tokens")


#: Session setting that names the folder of a cache that outlives the session.
CACHE_SETTING = "spark.factweave.tokenCache"


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the table that CACHE_SETTING names, which later runs find again; without the setting it starts empty."""
    import public_tokenizers

    cache = spark.conf.get(CACHE_SETTING, "") or shared_dir(spark, "token-counts")
    counted = count_tokens(table(spark, sf_dir, "documents"), cache, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_token_counts": _query}
ORACLE: dict[str, str] = {}
