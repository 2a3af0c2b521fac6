"""Token counts by a given vocabulary: batch encoding that returns lengths only.

Texts are cut at ASCII white space.  The tokenizer here drops white space and no token spans it,
so a text's count is the sum over its pieces, and no piece of a long text can be too large unless
it is one unbroken word.  Pieces go to the library in batches of about equal bytes; a bounded
memory per worker keeps counts of pieces it has met, as most words come again and again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted one by
one; other columns are not read, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import over_batches

BATCH_BYTES = 1 << 18  #: bytes of one call to the library
REMEMBERED = 1_000_000  #: pieces whose counts a worker keeps
LONGEST_KEPT = 48  #: longer pieces are counted anew each time
_SPACES = str.maketrans("\t\n\r", "   ")
_WORKER: dict = {}  # per Python worker: the tokenizer and the counts it has found


def _encoder(path: str):
    if _WORKER.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives one core to a task
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _WORKER.update(path=path, tokenizer=tokenizer, known={"": 0})
    return _WORKER["tokenizer"]


def balanced(pieces: list[str], most: int = BATCH_BYTES):
    """Lists of consecutive pieces with at most ``most`` bytes, or one larger piece alone."""
    batch, size = [], 0
    for piece in pieces:
        n = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += n
    if batch:
        yield batch


def text_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    encoder = _encoder(path)
    known = _WORKER["known"]
    cut = [t.translate(_SPACES).split(" ") for t in texts]
    new = set()
    for pieces in cut:
        new.update(pieces)
    new.difference_update(known)
    new = sorted(new, key=len)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        known[""] = 0
        new = sorted(set(chain.from_iterable(cut)) - {""}, key=len)
    once = {}
    for batch in balanced(new):
        lengths = map(len, encoder.encode_batch(batch, add_special_tokens=False))
        for piece, n in zip(batch, lengths):
            (known if len(piece) <= LONGEST_KEPT else once)[piece] = n
    if not once:
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]
    return [sum(known[p] if p in known else once[p] for p in pieces) for pieces in cut]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = plain.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))

    def work(batch):
        lengths = text_lengths(batch.column("text").to_pylist(), tokenizer)
        return {key: batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_tokens": lengths,
                "over_limit": [n > limit for n in lengths]}

    return over_batches(
        sized, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", work)
