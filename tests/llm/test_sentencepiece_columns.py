import hashlib
import random
import re

import pyarrow as pa
import pytest

from cipherledger.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.read_pieces(S.MODEL))


def odd_texts(n):
    rng = random.Random(11)
    alphabet = "abcdeéñß  ,.\n_%$\"'日😀0123456789ABC▁ \t\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 30, 80, 400]))) for _ in range(n)]
    return texts + [None, "", " ", "  ", "▁", "▁▁", " ▁ ", "a ", "a  ", " a", "x" * 3000, "é" * 3000 + " b", "\n" * 300, "plain words only"]


class Counting(dict):
    calls = 0

    def get(self, *a):
        self.calls += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.calls += 1
        return super().__getitem__(k)

    def __contains__(self, k):
        self.calls += 1
        return super().__contains__(k)


def test_a_word_is_looked_up_once_for_all_its_places(codec):
    codec.words = words = Counting()
    texts = ["the owner of the house and the dog " * 100 + f"n{i}" for i in range(40)]
    ids = codec.encode_all(texts)
    assert [codec.decode(x) for x in ids] == texts
    assert words.calls < 1000  # 28,000 places, 46 words


def test_slices_are_texts_one_by_one(codec):
    texts = odd_texts(600)
    whole = pa.array(texts)
    total = lambda ids: sum(codec.score[i] for i in ids if codec.pieces[i][2] == "normal")
    for at in range(0, len(texts), 97):
        codec.forget()
        ids, to = codec.encode_column(whole.slice(at, 97))
        for t, a, b in zip(texts[at : at + 97], to, to[1:]):
            own = ids[a:b].tolist()
            words = re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁")) if t else []
            plain = [i for w in words for i in codec.viterbi(w)]
            assert own == plain or (codec.decode(own) == codec.decode(plain) and abs(total(own) - total(plain)) < 1e-6), t


def test_small_room_and_surrogates(codec):
    texts = odd_texts(300) + ["\ud800 a", "x\udfff y"]
    want = codec.encode_all(texts)
    tight = S.Codec(list(codec.pieces))
    tight.room = 20
    assert [tight.encode(t) for t in texts] == want and len(tight.words) < 1000


def test_derived_columns(spark, codec):
    texts = odd_texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = S.encoded(df).collect()
    assert len(got) == len(texts)
    low, high = codec.byte_id[0], codec.byte_id[255]
    for r in got:
        t, ids = texts[r.doc_id], r.token_ids
        if t is None:
            assert list(r)[1:] == [None] * 5
            continue
        assert ids == codec.encode(t)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert list(r)[2:] == [len(ids), sum(low <= i <= high for i in ids), sha, codec.decode(ids) == t]
    assert {r.round_trip for r in got} == {True, False, None}
    assert dict(S.encode(df, ids="ids").select("doc_id", "ids").collect()) == {r.doc_id: r.token_ids for r in got}


def test_steps_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(S, "STEP_BYTES", 10)
    monkeypatch.setattr(S, "STEP", 3)
    texts = pa.array(["a" * 50, "b", None, "", "c", "d" * 6, "e" * 6, "f" * 11])
    assert list(S._steps(texts)) == [(0, 1), (1, 3), (4, 2), (6, 1), (7, 1)]
    assert list(S._steps(texts.slice(0, 0))) == []
