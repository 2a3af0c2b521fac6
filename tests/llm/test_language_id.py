import random
import zlib

import pytest

from fareloom.llm import language_id as L

SYLLABLES = {"en": "the and ing tion of er wh".split(), "de": "die der ung keit ü ß sch".split(),
             "fr": "le que eau ment é oux eux".split()}


def sentence(rnd, lang, words):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.choice([4, 12, 60, 3000])), lang, "s", 1)
            for i in range(600)]
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "12 ... !", "de", "s", 1),
             (None, "the thing", "en", "s", 1), (1003, "the and the whing of the", None, "s", 1),
             (5, rows[5][1], rows[5][2], "s", 1), (1004, "ü" * 30_000, None, "s", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, packed int")


def test_held_out_texts_get_their_language(docs):
    rows, frame = docs
    got = L.languages(frame).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang, *_ in rows if i is not None and i < 600}
    tested = [r for r in got if r.doc_id in want and r.held_out]
    assert len(tested) > 100
    assert sum(r.lang_pred == want[r.doc_id] for r in tested) >= 0.99 * len(tested)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[1004].lang_pred == "de"


def test_sizes_are_those_of_a_plain_restatement(docs):
    import re

    import zstandard
    rows, frame = docs
    books = L.learn(frame.where(~L.held_out()))
    assert set(books) == set(SYLLABLES) and all(len(b) <= L.DICTIONARY for b in books.values())
    got = {r.doc_id: r for r in L.identify(frame, books).collect()}
    for i, text, *_ in rows[:80]:
        plain = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        sizes = {}
        for lang, book in books.items():
            left, sizes[lang] = plain, 0
            while left:
                piece = left if len(left) <= L.PIECE else left[:left.rindex(" ", 1, L.PIECE)]
                packer = zstandard.ZstdCompressor(level=L.LEVEL, write_content_size=False, write_dict_id=False,
                                                  dict_data=zstandard.ZstdCompressionDict(
                                                      book, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                sizes[lang] += len(packer.compress(piece.encode()))
                left = left[len(piece):]
        assert abs(sizes[got[i].lang_pred] - min(sizes.values())) <= 0.01 * min(sizes.values()), (i, sizes)


def test_narrow_margins_are_rejected():
    book = {"a": b"one two three four", "b": b"one two three four"}
    assert L.judge("one two three", book) == ("a", 0.5, True)
    assert L.judge("one", {}) == ("und", 0.0, True)
    lang, score, narrow = L.judge("one two three four five six", {"a": b"x", "b": b"one two three four five six"})
    assert lang == "b" and score > 0.9 and not narrow


def test_pieces_hold_the_whole_text():
    for text in ("", "a", "ab " * 9000, "x" * 20_000, " ".join(["long" * 3000] * 3)):
        assert b"".join(L.cut(text)).decode() == text and all(len(p) <= L.PIECE for p in L.cut(text))


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.languages(none).collect()] == [("und", 0.0)] * 2
    assert L.languages(none.limit(0)).count() == 0


def test_rejected_texts_can_be_named(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "zzz")], "doc_id long, text string")
    got = L.identify(docs, {"a": b"one two three", "b": b"one two three"}, reject="und").collect()
    assert [r.lang_pred for r in got] == ["und", "und"]
