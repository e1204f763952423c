import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from cipherledger.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.read_pieces(S.MODEL))


@pytest.fixture(scope="module")
def library(codec):
    """The public library's own Unigram search with the same pieces and scores."""
    m = pb.ModelProto()
    m.ParseFromString(open(S.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for p, s in zip(m.pieces, codec.score):
        p.score = s
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


TEXTS = ["", "a", "Hello  world é\n😀 tokenization", " lead and trail ", "x" * 500, "tab\tand more…", "0x1F_foo.bar(baz)", "日本語のテキスト", "\x00\x01", "a▁b"]


def test_same_sum_as_library(codec, library):
    rng = random.Random(3)
    alphabet = "abcdeéñß  ,.\n_%$\"'日😀0123456789ABC"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    total = lambda ids: sum(codec.score[i] for i in ids if codec.pieces[i][2] == "normal")
    for t in texts:
        own, other = codec.encode(t), library.encode(t)
        assert own == other or abs(total(own) - total(other)) < 1e-3, t
        assert codec.decode(own) == library.decode(own)


def test_round_trip_and_batches(codec):
    texts = [t for t in TEXTS if "▁" not in t] * 20
    got = codec.encode_all(texts)
    assert [codec.decode(x) for x in got] == texts
    assert got == [S.Codec.encode(codec, t) for t in texts]


def test_trie(codec):
    words = [p.encode() for p, _, k in codec.pieces if k == "normal"]
    t = S.DoubleArray(words)
    for i in range(0, len(words), 371):
        assert (len(words[i]), i) in t.prefixes(words[i])


def test_many_is_one(codec):
    chunks = [f"word{i}x"[: 3 + i % 9] for i in range(3000)]
    assert codec.viterbi_all(chunks) == [codec.viterbi(c) for c in chunks]


def test_frames(odd, empty):
    got = S.encoded(odd).collect()
    assert len(got) == odd.count() and all(r.round_trip in (True, None) for r in got)
    assert [r.token_ids for r in got if r.doc_id == 2] == [None] and [r.token_ids for r in got if r.doc_id == 3] == [[]]
    assert S.encoded(empty).count() == 0
    twice = S.decode(S.encode(odd, ids="ids"), ids="ids", text="back")
    assert twice.where("not (text <=> back)").count() == 0
    assert S.tokenized(odd.sparkSession, odd, "").columns[-2:] == ["token_ids_", "n_tokens"]
