import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from lodestrata.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["a" * 5000, "Zb" * 900, "é中​　 x\r\n\n  \t y", "don't  we'll  1234567 ###$$%%  ", "\U0001f600\U0001f601 ok", "\x1c\x1d \x85\xa0q", "<|endoftext|> x", "ÀÉ" * 400 + "ßq"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_library_and_decodes(docs, texts, library):
    rows = [(i, t) for i, t in enumerate([*texts, *ODD])] + [(None, "null id"), (3, "one")]
    got = bpe.encode(docs(rows), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    for (key, text), r in zip(rows, got, strict=True):
        assert r.doc_id == key and list(r.ids) == library.encode_ordinary(text or "")
        assert bytes(r.decoded) == (text or "").encode()


def test_decode_alone_and_empty(spark, docs, library):
    ids = library.encode_ordinary("round trip, ça va")
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded).decode() for r in bpe.decode(df, RANKS).collect()} == {1: "round trip, ça va", 2: b"", 3: None}
    assert bpe.encode(docs([]), RANKS, P.PATTERN).count() == 0


def test_random_long_words_agree_with_one_contraction_at_a_time(library):
    import random

    codec = bpe._codec(open(RANKS, "rb").read())[0]
    rng = random.Random(1)
    for _ in range(4):
        w = "".join(rng.choice("etaoinshrdluZ") for _ in range(2000)).encode()
        assert codec.encode([w])[0].tolist() == codec._short([w])[0].tolist() == library._encode_single_piece(w)


def one_at_a_time(ranks, word):
    t = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[t[i] + t[i + 1]], i) for i in range(len(t) - 1) if t[i] + t[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[x] for x in t]
        t[best[1] : best[1] + 2] = [t[best[1]] + t[best[1] + 1]]


def test_long_words_of_tables_where_the_order_matters(monkeypatch):
    import random

    monkeypatch.setattr(bpe, "LONG_WORD", 4)
    single = {bytes([b]): b for b in range(256)}
    codec = bpe.Codec(single | {b"aba": 256, b"ab": 257})
    assert codec.encode([b"ab" * 300])[0].tolist() == one_at_a_time(codec.ranks, b"ab" * 300) == [256, 98] * 150
    rng = random.Random(3)
    for _ in range(12):
        tokens = sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(tokens)
        codec = bpe.Codec(single | {t: 256 + i for i, t in enumerate(tokens)})
        for n in (5, 17, 60):
            w = bytes(rng.choices(b"abc", k=n))
            if w not in codec.ranks:
                assert codec.encode([w])[0].tolist() == one_at_a_time(codec.ranks, w), (codec.ranks, w)


def test_query_digests(spark, library):
    from lodestrata.llm.queries import op1_byte_bpe

    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op1_byte_bpe(spark, d).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
