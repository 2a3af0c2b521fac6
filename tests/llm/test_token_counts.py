import public_tokenizers
from tokenizers import Tokenizer

from fareloom.llm.token_counts import balanced, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_those_of_whole_texts(spark):
    texts = [None, "", " \n\t ", "It's we've  they'll\nn't 1234 <|endoftext|>x <|startoftext|>",
             "ÉCOLE Ünïcode ́a á ΣΑΣ 日本 \x1c\x85 b c " * 3000, "z" * 50_000,
             "don't\r\n\r\n", "tab\tend 😀😀 %%%&&&"]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts + texts[3:5])],
                                 "doc_id long, text string, n_tokens int, over_limit boolean")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    plain = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts + texts[3:5]):
        want = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (want, len((t or "").encode())), i
        assert got[i].over_limit == (want > 2048)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_batches_hold_equal_bytes():
    batches = list(balanced(["é" * 40] * 10 + ["x" * 1000, "y"], 200))
    assert [len(b) for b in batches] == [2, 2, 2, 2, 2, 1, 1]
