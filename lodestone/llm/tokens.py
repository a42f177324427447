"""Token counts by a public tokenizer, given as a file of ranks; the file is never part of this repository."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies by default, and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file: lines of a token in base 64 and its rank. Loaded once for each worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: White space as the pattern knows it (Unicode's White_Space), in runs so long that its engine, which steps back one by
#: one from their end, runs out of stack.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def count_tokens(text: str, enc) -> int:
    """Tokens of the whole text. A very long run of white space is handed to the merges as the one piece the pattern
    makes of it: all of it at the end of the text, else all but the last, which may belong to what follows."""
    total = at = 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def token_counts(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` of every text that isn't null or blank (of white space only)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            ids, sizes = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                if t and not t.isspace():
                    ids.append(i)
                    sizes.append(count_tokens(t, enc))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(read, "doc_id bigint, tokens bigint")
