from __future__ import annotations

import hashlib
import random

import pytest

from lapidary.llm import piece_codec

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

EDGES = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb", "\t x", "a▁b", "▁", "▁▁ ▁", "é́", "日本語𝕏𝕏 x", "<s> </s> <unk> <0x0A>", "\x00a", "�", "ab\xa0c", " " * 40 + "the", "a" * 5000, "ab" * 3000 + " " * 100]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(public_tokenizers.path(piece_codec.MODEL), most=50)


def _by_merges(scores: dict, text: str) -> list[str]:
    parts = list(text)
    while True:
        pairs = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not pairs:
            return parts
        i = -max(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ids_are_the_librarys(codec, library):
    rng = random.Random(3)
    pieces = list(codec.ids)
    letters = " ▁ab\n\té日𝕏theing10<>.,'   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).replace("▁", " ") for _ in range(3000)]
    texts += [" " * n + end for n in range(70) for end in ("", "a", "the", "\n")] + [t or "" for t in EDGES]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t), repr(t)
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("seed", range(40))
def test_backtracking_equals_merging_on_random_vocabularies(seed):
    """Small alphabets and vocabularies out of trained-like merges need many retries."""
    rng = random.Random(seed)
    pieces = list("abc")
    while len(pieces) < 3 + seed:
        p = rng.choice(pieces) + rng.choice(pieces)
        if p not in pieces and len(p) < 9:
            pieces.append(p)
    scores = {p: -float(i) for i, p in enumerate(pieces)}
    merges = piece_codec.Merges(scores)
    for _ in range(400):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert merges.encode(text) == _by_merges(scores, text), text


def test_equal_scores_of_different_pieces_are_refused():
    with pytest.raises(ValueError, match="share a score"):
        piece_codec.Merges({"a": -1.0, "b": -2.0, "ab": -3.0, "ba": -3.0})


def test_pieces_that_no_merge_makes_are_left_out():
    merges = piece_codec.Merges({"a": -1.0, "b": -2.0, "c": -3.0, "ab": -4.0, "abc": -5.0, "bca": -6.0})
    assert merges.encode("bca") == ["b", "c", "a"]
    assert merges.encode("abca") == ["abc", "a"]


def test_round_trip_over_a_table(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(EDGES)] + [(None, "no id", "x", "y"), (2**53 + 1, "large id", "x", "y"), (3, EDGES[3], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    found = sorted(map(tuple, piece_codec.round_trip(docs).collect()), key=str)

    def want(doc, text):
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        return (doc, len(ids), *sha)

    assert found == sorted((want(r[0], r[1]) for r in rows), key=str)
    ids = piece_codec.encoded(docs)
    back = {r.doc_id: r.text for r in piece_codec.decoded(ids).collect()}
    assert back[5] == " a" and back[0] == "" and back[None] == "no id"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.round_trip(docs).collect() == []
    assert piece_codec.round_trip(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
