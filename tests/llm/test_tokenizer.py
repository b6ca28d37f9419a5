import random

import pytest

from factloom.llm import tokenizer as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P

    path = T.vocabulary_path()
    return T.Encoder(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=T.load_ranks(path), special_tokens={})


def test_same_ids_and_round_trip(both):
    own, ref = both
    rng = random.Random(5)
    alphabet = "abcdefgh ÄÖüß€\n\t0123456789.,'’😅👍漢字яé​"
    texts = ["", " ", "hello world", "Grüße aus Köln  \n\n", "<|endoftext|>", "I'll've", "a" * 3000, "😅" * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for t in texts:
        ids = own.encode(t)
        assert ids == ref.encode_ordinary(t) and own.decode(ids) == t


def test_long_piece_is_fast(both):
    own, ref = both
    t = "".join(random.Random(1).choice("abc") for _ in range(60_000))
    assert own.encode(t) == ref.encode_ordinary(t)


def test_rows(spark, both):
    d = spark.createDataFrame([(1, "hi there", 5), (2, None, 5), (3, "", 5), (1, "hi there", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in T.token_ids(d).collect())
    assert got == [(1, both[1].encode_ordinary("hi there"))] * 2 + [(2, []), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in T.token_ids(d, counts_only=True).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert T.token_ids(d.limit(0)).count() == 0 and T.vocabulary_use(T.token_ids(d)).count() == 2
