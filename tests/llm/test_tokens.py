import random

import pytest

from echofold.llm.tokens import encode, encoded, vocabulary_path

PATH = vocabulary_path()


def texts():
    rng = random.Random(3)
    parts = ["hello world", "  ", "\n\n", "it's", "don't'll", "größe", "日本語のテキスト", "🙂🙂", "1234567", "A" * 300, " " * 300, "\t \t", "<|endoftext|>", "ab12" * 80, "!?!?", "'s", "é́", "\x1c", "　", "\r\n"]
    return ["", None, " ", "x", "a" * 5000, " " * 5000, "a b " * 2000] + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (50, 20), (300, 64), (8192, 512)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    rows = list(enumerate(texts())) + [(3, "x"), (None, "hello")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, idx int, key string")
    got = sorted(((r.id is None, r.id or 0, list(r.ids)) for r in encoded(df, chunk=chunk, overlap=overlap).collect()))
    assert got == sorted((i is None, i or 0, encode(t or "", PATH).tolist()) for i, t in rows)
    counts = sorted((r.id is None, r.id or 0, r.n) for r in encoded(df, chunk=chunk, overlap=overlap, count=True).collect())
    assert counts == [(a, b, len(c)) for a, b, c in got]


def test_round_trip_and_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    from echofold.llm.tokens import _encoding

    for t in texts():
        ids = encode(t or "", PATH).tolist()
        assert _encoding(PATH)[0].decode(ids) == (t or "")
        if t and len(t) < 4000:
            assert other.encode(t, add_special_tokens=False).ids == ids


def test_white_space_beyond_the_regex_limit():
    ids = encode("a" + " " * 1_000_000 + "b", PATH)
    from echofold.llm.tokens import _encoding

    assert _encoding(PATH)[0].decode(ids.tolist()) == "a" + " " * 1_000_000 + "b"


def test_empty(spark):
    assert encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decoding_gives_the_texts_back(spark):
    from echofold.llm.tokens import decoded

    rows = list(enumerate(texts()))
    back = {r.id: r.text for r in decoded(encoded(spark.createDataFrame(rows, "doc_id long, text string"), chunk=300, overlap=64)).collect()}
    assert back == {i: t or "" for i, t in rows}
    ids = encode("日本語 text", PATH).tolist()
    odd = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "id long, ids array<int>")
    got = {r.id: r.text for r in decoded(odd).collect()}
    assert got[1] == "日本語 text" and got[2] in "日本\ufffd" and got[3] == "" and got[4] is None
    with pytest.raises(Exception, match="outside"):
        decoded(spark.createDataFrame([(1, [10**7])], "id long, ids array<int>")).collect()
