"""Sizes of texts in tokens of a public tokenizer (never trained here)."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textverk.sources.tables import spread

RANKS = "byte_bpe_multi_50k.tiktoken"


def encoder(ranks: str | None = None, pattern: str | None = None):
    """A byte-level BPE encoder; ``ranks`` is the path of its vocabulary file."""
    import tiktoken

    if ranks is None or pattern is None:
        import public_tokenizers as P

        ranks, pattern = ranks or P.path(RANKS), pattern or P.PATTERN
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def sizes(df: DataFrame, text: str, ranks: str | None = None, extra: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """All other columns of ``df`` and n_tokens; rows with null text are left out, '' has 0.

    ``extra`` has more columns that one pass over the text gives: name to (type, function)."""
    extra = extra or {}
    keep = [c for c in df.columns if c != text]
    fields = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens int" + "".join(f", {k} {t}" for k, (t, _) in extra.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            texts = b.column(text).to_pylist()
            n = [len(enc.encode_ordinary(t)) for t in texts]
            more = [pa.array([f(t) for t in texts]) for _, f in extra.values()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int32()), *more], names=[*keep, "n_tokens", *extra])

    src = df.filter(F.col(text).isNotNull())
    return spread(src, *keep[:1]).select(*keep, text).mapInArrow(run, schema)
