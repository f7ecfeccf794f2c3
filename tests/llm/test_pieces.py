"""SentencePiece ids and texts against the library."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece
from fleetlens.llm import piece_tokens
from fleetlens.llm.piece_tokens import MergeRules, PieceCodec

from llm.texts import HARD, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PATH)


def check(codec, library, texts):
    for text, data in zip(texts, codec.encode(texts), strict=True):
        ids = array("I", data)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert codec.decode(ids) == library.decode(ids.tolist()), text


def test_hard_texts_and_prose(codec, library):
    check(codec, library, [t or "" for t in HARD] + [prose(i, 150) for i in range(40)])
    check(codec, library, ["</s>", "<s> <unk>", "<0x41>", "▁", " ▁ ▁▁", " " * 40, "a" + " " * 17 + "b", "\n" * 20, "日本。" * 50, "\x00\x00"])


def test_random_texts(codec, library):
    draw = random.Random(4)
    pieces = sorted(codec.ids)
    check(codec, library, ["".join(draw.choices(" abnstehinrodg▁\n\t.é日🙂", k=draw.randrange(60))) for _ in range(4000)])
    check(codec, library, ["".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(4000)])
    check(codec, library, ["".join(draw.choices(" aei", k=draw.randrange(80))) for _ in range(2000)])


def test_decoding_of_any_ids(codec, library):
    draw = random.Random(5)
    for _ in range(5000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3)]) for _ in range(draw.randrange(12))]
        assert codec.decode(array("I", ids)) == library.decode(ids), ids


def test_long_texts_without_blanks(codec, library):
    check(codec, library, ["日本語の文章です。" * 12_000, "ab" * 50_000, prose(3, 500).replace(" ", "") * 20])


@pytest.mark.parametrize("seed", range(40))
def test_neighbours_stay_apart_just_where_merging_leaves_them(seed):
    """Over made-up vocabularies, also with equal ranks and pieces that are made before their halves."""
    draw = random.Random(seed)
    letters = "abc"
    pieces = {"".join(draw.choices(letters, k=draw.randrange(2, 6))) for _ in range(25)} | set(letters)
    ranks = {p: float(draw.randrange(8 if seed % 2 else 1000)) for p in pieces}
    if seed % 4 < 2:  # longer pieces later, as in a trained vocabulary
        ranks = {p: len(p) * 10_000 + r for p, r in ranks.items()}
    rules = MergeRules(ranks)
    whole = [p for p in pieces if len(p) == 1 or p in rules.halves]
    for left in whole:
        for right in whole:
            if rules.in_order:
                assert rules.apart(left, right) == (rules.merged(left + right) == [left, right]), (left, right, ranks)


def test_round_trip(make, library):
    rows = [*enumerate(HARD), (5, "again"), (5, "again"), (None, "no id"), (7, "very long " * 50_000)]
    wanted = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_eos=True)
        digests = (" ".join(map(str, ids)), library.decode(ids))
        wanted.append((doc_id, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    found = piece_tokens.round_trip(make(rows), PATH).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert piece_tokens.round_trip(make([]), PATH).collect() == []


def test_ids_and_texts(make, library):
    rows = list(enumerate(HARD))
    encoded = piece_tokens.encoded(make(rows), PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode(t or "", add_eos=True) for i, t in rows}
    assert {r.doc_id: r.text for r in piece_tokens.decoded(encoded, PATH).collect()} == {i: t or "" for i, t in rows}
    none = encoded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids").limit(1)
    assert piece_tokens.decoded(none, PATH).first().text == ""
    row = piece_tokens.encoded(make([(1, "a")]), PATH, carry=True).first()
    assert row["rest"].n_words == "x" and row["rest"]["rest"] == 1


def test_other_models_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="without normalization"):
        PieceCodec(str(tmp_path / "other.model"))
