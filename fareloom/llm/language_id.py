"""Language of a text by compression: the dictionary that packs it best names the language.

Each language has a zstandard dictionary of raw content: pieces of labelled texts, joined.  A text is
brought to lower-case letters and single spaces, cut into pieces at spaces, and every piece is packed
once per language; the language of the smallest sum wins.  Pieces keep the dictionary in reach of a
long text's every part and bound the memory of a call; whole texts are read.

Where the margin is narrow, as in texts of a few words, the sizes are taken again by a finer packing
that uses matches of three bytes.  ``score`` is the winner's share when a language that needs k bytes more counts 2 ** -k.  A text is
``rejected`` where the second language needs less than ``MARGIN`` (a share of the smallest sum) or
``MARGIN_BYTES`` more; ``identify(..., reject="und")`` gives such texts that name.

The fit is a bounded sample of labelled rows: of the ``MOST_LANGUAGES`` commonest languages, the
``FIT_ROWS`` rows with the smallest hashes each, one piece of ``FIT_CHARS`` characters at a place
chosen by the hash, up to ``DICTIONARY`` bytes.  So what is broadcast stays below 256 times 32 KB.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without labelled
rows every text is; equal sizes go to the language with more labelled rows, then by name; repeated
rows are judged one by one; a null key is held out; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import over_batches

DICTIONARY = 32_768
FIT_ROWS, FIT_CHARS = 160, 768
MOST_LANGUAGES = 256
PIECE = 8192  #: characters packed at once
LEVEL, FINE_LEVEL = 6, 19
MARGIN, MARGIN_BYTES = 0.01, 2
UNKNOWN = "und"
_WORKER: dict = {}  # per Python worker: the compressors of the dictionaries in use


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows that no fit may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(True))


def letters(text: str):
    """Lower-case letters (with their marks) and single spaces; null becomes the empty text."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.when(plain.rlike(r"\p{L}"), F.trim(plain)).otherwise("")


def learn(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Language to dictionary, the language with most labelled rows first."""
    labelled = (train.select(F.col(label).cast("string").alias("lang"), letters(text).alias("plain"),
                             F.xxhash64(F.col(key).cast("string"), F.lit("fit")).alias("h"))
                .where("lang is not null and plain <> ''"))
    common = (labelled.groupBy("lang").agg(F.count("*").alias("rows"))
              .orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES))
    start = F.pmod("h", F.greatest(F.lit(1), F.length("plain") - FIT_CHARS + 1)).cast("int") + 1
    pieces = labelled.select("lang", "h", F.substring("plain", start, F.lit(FIT_CHARS)).alias("piece"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    chosen = pieces.withColumn("nth", nth).where(F.col("nth") <= FIT_ROWS).join(F.broadcast(common), "lang")
    content: dict[str, bytes] = {}
    for row in sorted(chosen.collect(), key=lambda r: (-r.rows, r.lang, r.nth)):
        so_far = content.get(row.lang, b"")
        if len(so_far) < DICTIONARY:
            content[row.lang] = so_far + row.piece.encode("utf-8", "ignore") + b" "
    return {lang: data[:DICTIONARY] for lang, data in content.items()}


def _packers(dictionaries: dict[str, bytes], fine: bool) -> list[zstandard.ZstdCompressor]:
    if _WORKER.get("of") != dictionaries:
        packers, finer = [], []
        for data in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(LEVEL)
            packers.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False))
            closer = zstandard.ZstdCompressionParameters.from_level(
                FINE_LEVEL, min_match=3, window_log=17, write_content_size=False, write_dict_id=False)
            finer.append(zstandard.ZstdCompressor(compression_params=closer, dict_data=zstandard.ZstdCompressionDict(
                data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
        _WORKER.update(of=dictionaries, packers=(packers, finer))
    return _WORKER["packers"][fine]


def cut(text: str, most: int = PIECE) -> list[bytes]:
    """Pieces of at most ``most`` characters, cut at the last space in reach (in a longer word, inside it)."""
    pieces, at = [], 0
    while len(text) - at > most:
        end = text.rfind(" ", at + 1, at + most)
        end = end if end > 0 else at + most
        pieces.append(text[at:end])
        at = end
    pieces.append(text[at:])
    return [p.encode("utf-8", "surrogatepass") for p in pieces]


def packed_sizes(text: str, dictionaries: dict[str, bytes], fine: bool = False) -> list[int]:
    """Bytes that the text takes under each dictionary."""
    pieces = cut(text)
    return [sum(len(packer.compress(p)) for p in pieces) for packer in _packers(dictionaries, fine)]


def _ranked(sizes: list[int]) -> tuple[int, int, bool]:
    """Place of the smallest size, the size, and whether the next is too near."""
    least = min(sizes)
    first = sizes.index(least)
    second = min((s for i, s in enumerate(sizes) if i != first), default=None)
    return first, least, second is not None and second - least < max(MARGIN_BYTES, MARGIN * least)


def judge(text: str, dictionaries: dict[str, bytes]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is too narrow, of a text of letters."""
    if not text or not dictionaries:
        return UNKNOWN, 0.0, True
    sizes = packed_sizes(text, dictionaries)
    first, least, narrow = _ranked(sizes)
    if narrow:
        sizes = packed_sizes(text, dictionaries, fine=True)
        first, least, narrow = _ranked(sizes)
    return list(dictionaries)[first], 1.0 / sum(2.0 ** -min(s - least, 1000) for s in sizes), narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], reject: str | None = None, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``key``, lang_pred, score, rejected of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batch):
        found = [judge(t, shared.value) for t in batch.column("text").to_pylist()]
        return {key: batch.column("id"),
                "lang_pred": [reject if narrow and reject else lang for lang, _, narrow in found],
                "score": [score for _, score, _ in found], "rejected": [narrow for _, _, narrow in found]}

    return over_batches(docs.select(F.col(key).alias("id"), letters(text).alias("text")),
                        f"`{key}` {kind}, lang_pred string, score double, rejected boolean", work)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, learned outside the held-out fold."""
    return identify(docs, learn(docs.where(~held_out()))).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
