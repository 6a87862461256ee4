"""SentencePiece encoding against the library, and the exact order of merges on other vocabularies."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerline.llm import pieces

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
WORDS = "the theatre Haus übergröße 東京 \U0001f600 </s> <0x41> naïve a▁b 12345 ++-- ﬁ x\x00y ht ththth nananana".split(" ")


def texts(seed, n=300):
    rnd = random.Random(seed)
    out = ["", " ", "   ", "▁", "\n", "\r\n", "\t \t", " a", "a ", "a  b", "a \n b", "\n\n a\n", " " * 5000, "ab" * 4000, "▁" * 40 + "x", "é" * 900, "�", "퟿"]
    for _ in range(n):
        t = "".join(rnd.choice([rnd.choice(WORDS), " " * rnd.randint(0, 20), rnd.choice("\n\t .,"), "".join(rnd.choice("abcdeht ▁") for _ in range(rnd.randint(0, 30))), chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x3000, 0x9FFF), rnd.randint(0x10000, 0x1FFFF)]))]) for _ in range(rnd.randint(0, 40)))
        out.append(t)
    return out


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("rounds, size, memo", [(128, 2_000_000, 200_000), (2, 50, 40), (0, 700, 3)])
def test_ids_and_texts_equal_the_library(library, monkeypatch, rounds, size, memo):
    for name, value in (("ROUNDS", rounds), ("SLICE", size), ("MEMO", memo)):
        monkeypatch.setattr(pieces, name, value)
    vocab, cases = pieces.Vocabulary(MODEL), texts(rounds)
    ids, counts = vocab.encode(cases)
    want = library.encode(cases, add_eos=True)
    assert split(ids, counts) == want
    assert vocab.decode(ids, counts) == library.decode(want)


def test_any_ids_decode_as_in_the_library(library):
    rnd = random.Random(5)
    lists = [[rnd.choice([rnd.randint(0, 31999), rnd.randint(3, 258), 0, 1, 2, 259, 28705]) for _ in range(rnd.randint(1, 12))] for _ in range(2000)]
    counts = np.array([len(x) for x in lists])
    assert pieces.Vocabulary(MODEL).decode(np.concatenate(lists), counts) == library.decode(lists)


def message(number, value):
    tag = (number << 3 | (2 if isinstance(value, bytes) else 5 if isinstance(value, float) else 0)).to_bytes(1 if number < 16 else 2, "little") if number < 16 else bytes([(number << 3 & 127) | 128 | (2 if isinstance(value, bytes) else 0), number >> 4])
    if isinstance(value, float):
        return tag + struct.pack("<f", value)
    size = len(value) if isinstance(value, bytes) else value
    out = b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return tag + out + bytes([size]) + (value if isinstance(value, bytes) else b"")


def model_of(scored):
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] + [(p, s, 1) for p, s in scored]
    body = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in every)
    return body + message(2, message(3, 2) + message(35, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))


@pytest.mark.parametrize("seed", range(40))
def test_vocabularies_in_any_order(seed):
    """Pieces with scores in any order and ties, where merges of one piece open better pairs."""
    rnd = random.Random(seed)
    made = {"".join(rnd.choice("ab▁c") for _ in range(rnd.randint(2, 5))) for _ in range(30)}
    scored = [(p, float(-rnd.randint(1, rnd.choice([4, 200])))) for p in sorted(made)] + [(c, -900.0) for c in "ab▁c"[: rnd.randint(2, 4)]]
    model = model_of(scored)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    cases = ["".join(rnd.choice("abc d▁") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    ids, counts = pieces.Vocabulary(model).encode(cases)
    assert split(ids, counts) == library.encode(cases, add_eos=True)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(message(2, message(3, 1)) + message(3, message(4, 0)))


def test_long_texts_take_no_square_time(library):
    rnd = random.Random(1)
    cases = [" " * 300_000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000)), "word and\n" * 100_000]
    ids, counts = pieces.Vocabulary(MODEL).encode(cases)
    assert split(ids, counts) == library.encode(cases, add_eos=True)


def test_rows_edges_and_clashing_columns(spark, saved, library):
    rows = [(k, t, 7, "x") for k, t in enumerate(texts(3, 40))] + [(None, None, 7, "x"), (5, "again", 7, "x"), (5, "again", 7, "x")]
    docs = saved(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(map(tuple, pieces.digest(pieces.encode_pieces(docs, MODEL)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    out = pieces.encode_pieces(docs, MODEL, keep=["doc_id", "ids", "text"])
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert pieces.encode_pieces(saved([], "doc_id long, text string"), MODEL).count() == 0
    assert pieces.encode_pieces(spark.sql("select 1L doc_id, cast(X'61FF62' as string) text"), MODEL).first()["decoded"] == "a�b"
