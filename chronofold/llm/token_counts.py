"""Token counts of whole texts by map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens.
Tier one is a hash table of frequent pre-tokens and their lengths, broadcast once: every entry of
the vocabulary that is one pre-token, so its size is bounded by the vocabulary and not by the data.
Tier two is a bounded cache in each Python worker for pre-tokens that the table lacks, filled by
encoding them. Nothing is shuffled. Texts with characters for which pattern engines may disagree
(beyond U+024F and a few others) go to the library as a whole; so does a text with the special string, whose default
treatment (one token) is thus kept.

Null and empty texts have 0 tokens; a text of any length is counted whole; repeated rows are
counted each; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.arrow import chunks, map_batches, text_bytes

DEFAULT = "byte_bpe_50k.json"
OVER = 1024
CACHE = 1_000_000
#: The pattern that the vocabulary was made with, as Python's engine matches it up to U+024F.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
#: Where the engines differ: other scripts, numbers that are no digits, separators that only Python takes for white space.
ODD = "[^\x00-\u024f]|[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]"


def load(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def frequent_lengths(name: str = DEFAULT) -> dict[str, int]:
    """Lengths in tokens of the vocabulary's entries that are single pre-tokens."""
    tokenizer, split, odd = load(name), re.compile(PATTERN), re.compile(ODD)
    texts = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False)
    whole = [t for t in texts if t and not odd.search(t) and split.findall(t) == [t]]
    return {t: len(e) for t, e in zip(whole, tokenizer.encode_batch(whole, add_special_tokens=False))}


def rank_encoder(name: str):
    """The same vocabulary by merge ranks, which encodes a single pre-token sooner than the library."""
    import tiktoken

    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Lengths:
    """Pre-token lengths: the broadcast table and a cache of misses, emptied when full."""

    def __init__(self, frequent: dict[str, int], encoder):
        self.frequent, self.encode, self.known = frequent, encoder.encode_ordinary, dict(frequent)

    def totals(self, split_texts: list[list[str]]) -> list[int]:
        missing = set(filterfalse(self.known.__contains__, chain.from_iterable(split_texts)))
        if len(self.known) + len(missing) > len(self.frequent) + CACHE:
            self.known = dict(self.frequent)
            missing = set(filterfalse(self.known.__contains__, chain.from_iterable(split_texts)))
        self.known.update((x, len(self.encode(x))) for x in missing)
        return [sum(map(self.known.__getitem__, x)) for x in split_texts]


def count_tokens(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = DEFAULT, over: int = OVER) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of each row."""
    spark = SparkSession.getActiveSession()
    table = spark.sparkContext.broadcast(frequent_lengths(tokenizer))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, lengths = load(tokenizer), Lengths(table.value, rank_encoder(tokenizer))
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        split, odd = re.compile(PATTERN).findall, re.compile("|".join([ODD, *map(re.escape, special)])).search
        for batch in (part for full in batches for part in chunks(full, text)):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            left = {i for i, t in enumerate(texts) if odd(t)}
            n = np.array(lengths.totals([[] if i in left else split(t) for i, t in enumerate(texts)]), np.int64)
            for i in left:
                n[i] = len(whole.encode(texts[i], add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text_bytes(batch.column(text))), pa.array(n), pa.array(n > over)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(*keep, text), run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
