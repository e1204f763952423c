"""Operator 1. SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The piece vocabulary is read from a SentencePiece model file (a parameter; tokenizers are never trained here). A file
of merge ranks has no probabilities, so with ``scores="zipf"`` the piece of rank r gets the log probability of Zipf's
law, -ln(r) - ln(H_n); with ``scores="stored"`` the scores in the file are used as they are.

Semantics (those of the public library for a Unigram model with identity normalisation):
* a dummy prefix is put before a text that isn't empty, and spaces become the marker U+2581;
* the segmentation with the highest sum of log scores wins, an earlier start first among equal sums;
* a character that no piece covers alone costs the least score less 10, and becomes its UTF-8 byte pieces;
* decoding joins pieces, turns byte pieces into UTF-8 (invalid bytes into U+FFFD), markers into spaces, and strips
  the dummy prefix. A literal U+2581 in a text therefore comes back as a space.

A task works on columns: Arrow tells the words of a batch apart, a distinct word is looked up once for all its places, new ones are cut
and searched together in numpy, and ids, their decimals and the decoded texts are gathered for all places at once.

Null text: null ids. Empty text: no ids. Repeated rows have the same ids; an empty table gives no rows. ``encode`` and ``decode`` write the
columns they are asked to, over those of that name; the query and the stage ask for names that are free. Very long texts are cut only
where no piece can reach across, so work and memory are linear in the text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import clear_name, table
from .packed import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RAW_MARK = MARK.encode()
CACHE = 400_000  # remembered segmentations a worker
ROOM = 100_000  # the same where columns are encoded
STEP = 512  # texts segmented together
STEP_BYTES = 1 << 22  # the same, but for a longer text, which goes alone
WIDE = 64  # bytes of a chunk that is segmented with others, and of a word that is remembered
LENGTH = np.repeat(np.array([1, 2, 3, 4], np.int64), [0xC0, 0x20, 0x10, 0x10])  # bytes of a character by its first


def read_pieces(path: str) -> list[tuple[str, float, str]]:
    """``(piece, stored score, kind)`` by id; kind is normal, unknown, control or byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "byte" if p.is_byte(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.vocab_size())]


def zipf(pieces: list[tuple[str, float, str]]) -> list[float]:
    """Log probabilities by rank among the normal pieces, in the order of their ids; 0 for all others."""
    n = sum(kind == "normal" for _, _, kind in pieces)
    log_h, rank, out = math.log(sum(1 / r for r in range(1, n + 1))), 0, []
    for _, _, kind in pieces:
        rank += kind == "normal"
        out.append(float(np.float32(-math.log(rank) - log_h)) if kind == "normal" else 0.0)
    return out


def _ends(size: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and where the last one ends."""
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


def _gather(pool: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``codes`` of the pool one after the other, and the size of each."""
    begin = ends[codes]
    size = ends[codes + 1] - begin
    to = _ends(size)
    return pool[np.repeat(begin - to[:-1], size) + np.arange(to[-1])], size


class DoubleArray:
    """A trie over bytes in two arrays: the child of ``s`` by byte c is ``t = base[s] + c + 1`` if ``check[t] == s``."""

    def __init__(self, words: list[bytes]):
        root: dict = {}
        for i, w in enumerate(words):
            node = root
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 4096
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        todo, free = deque([(root, 0)]), 1
        while todo:
            node, s = todo.popleft()
            value[s] = node.get(-1, -1)
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            while check[free] != -1:
                free += 1
                if free + 300 > size:
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                    size *= 2
            b, tried = max(0, free - kids[0] - 1), 0
            while any(check[b + c + 1] != -1 for c in kids):
                b += 1
                tried += 1
                if b + 300 > size:
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                    size *= 2
            if tried > 64:  # a crowded stretch: later nodes start behind it
                free = max(free, b - 64)
                while check[free] != -1:
                    free += 1
            base[s] = b
            for c in kids:
                check[b + c + 1] = s
            for c in kids:
                todo.append((node[c], b + c + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, b: bytes, start: int = 0) -> list[tuple[int, int]]:
        """``(end, word)`` of every word that begins at ``start``."""
        s, out = 0, []
        for j in range(start, len(b)):
            t = self.base[s] + b[j] + 1
            if self.check[t] != s:
                break
            s = t
            if self.value[s] >= 0:
                out.append((j + 1, self.value[s]))
        return out


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]], scores: str = "zipf"):
        self.pieces = pieces
        self.score = zipf(pieces) if scores == "zipf" else [s for _, s, _ in pieces]
        normal = [i for i, p in enumerate(pieces) if p[2] == "normal"]
        self.unk = min(self.score[i] for i in normal) - 10.0
        self.unk_id = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        at = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == "byte"}
        self.byte_id = [at[b] for b in range(256)] if len(at) == 256 else None
        trie = DoubleArray([pieces[i][0].encode() for i in normal])
        self.base, self.check, self.trie = trie.base, trie.check, trie
        self.value = trie.value = [normal[v] if v >= 0 else -1 for v in trie.value]
        back = {i: b for b, i in at.items()}
        self.raw = [bytes([back[i]]) if i in back else b"" if p[2] == "control" else " ⁇ ".encode() if p[2] == "unknown" else p[0].encode() for i, p in enumerate(pieces)]
        self.text = [None if i in back else r.decode().replace(MARK, " ") for i, r in enumerate(self.raw)]
        # Characters that meet only each other and a marker before them inside pieces: no piece reaches across their edge.
        letters = {c for i in normal for c in pieces[i][0]} | {chr(c) for c in range(128)}
        apart = {c for c in letters if not (c.isalpha() or c.isdecimal() or c == MARK)}
        pairs = {(a, b) for i in normal for a, b in zip(pieces[i][0], pieces[i][0][1:])}
        inside = MARK in {b for a, b in pairs if a != MARK}
        while True:
            bad = {x for a, b in pairs for x, y in ((a, b), (b, a)) if x in apart and y not in apart and y != MARK}
            if not bad:
                break
            apart -= bad
        self.apart = np.zeros(0x110000, bool)
        if not inside:
            self.apart[[ord(c) for c in apart]] = True
        self.forget()
        self.room = CACHE
        self.decimal = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
        self.spelled = pa.array([r.replace(RAW_MARK, b" ") for r in self.raw], pa.large_binary())
        self.arrays = (*(np.array(x, np.int32) for x in (self.base, self.check, self.value)), np.array(self.score))

    def viterbi(self, chunk: str) -> tuple[int, ...]:
        b = chunk.encode("utf-8", "surrogatepass")
        n, base, check, value, score, unk = len(b), self.base, self.check, self.value, self.score, self.unk
        best, start, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = b[i]
            one = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, s, single, j = best[i], 0, False, i
            while j < n:
                t = base[s] + b[j] + 1
                if check[t] != s:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    x = here + score[v]
                    if best[j] is None or x > best[j]:
                        best[j], start[j], piece[j] = x, i, v
                    single |= j == one
            if not single:
                x = here + unk
                if best[one] is None or x > best[one]:
                    best[one], start[one], piece[one] = x, i, -1
            i = one
        out, j = [], n
        while j:
            i = start[j]
            if piece[j] >= 0:
                out.append(piece[j])
            elif self.byte_id:
                out.extend(self.byte_id[x] for x in reversed(b[i:j]))
            else:
                out.append(self.unk_id)
            j = i
        return tuple(reversed(out))

    def viterbi_all(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """``viterbi`` of many chunks at once."""
        ids, size = self._segment([c.encode("utf-8", "surrogatepass") for c in chunks])
        return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1])] if chunks else []

    def _segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each chunk has."""
        short = [k for k, b in enumerate(chunks) if 0 < len(b) <= WIDE]
        if len(short) < 32:
            short = []
        parts = [self._many([chunks[k] for k in short[at : at + 16384]]) for at in range(0, len(short), 16384)]
        alone = sorted(set(range(len(chunks))).difference(short)) if len(short) < len(chunks) else []
        rest = [self.viterbi(chunks[k].decode("utf-8", "surrogatepass")) for k in alone]
        ids = np.concatenate([i for i, _ in parts] + [np.fromiter(chain.from_iterable(rest), np.int32)])
        size = np.concatenate([n for _, n in parts] + [np.fromiter(map(len, rest), np.int64, len(rest))])
        if not alone:
            return ids, size
        order = np.empty(len(chunks), np.int64)
        order[short + alone] = np.arange(len(chunks))
        return _gather(ids, _ends(size), order)

    def _many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_segment`` by the steps of ``viterbi``, taken by all chunks together: the trie is walked from every character of
        every chunk at once, then the matches that begin at a chunk's first byte are weighed, at its second, and so on."""
        n = len(raw)
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)  # the byte after a chunk, in no UTF-8, is its end
        size = np.fromiter(map(len, raw), np.int64, n)
        last = np.cumsum(size + 1) - 1
        first = last - size
        base, check, value, score = self.arrays
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
        char, single = LENGTH[text], np.zeros(len(text), bool)
        live, s, d, found = lead, np.zeros(len(lead), np.int32), 0, []
        while len(live):
            t = base[s] + text[live + d] + np.int32(1)
            ok = check[t] == s
            live, s = live[ok], t[ok]
            d += 1
            v = value[s]
            hit = v >= 0
            at = live[hit]
            found.append((at, at + d, v[hit]))
            single[at[char[at] == d]] = True
        at = lead[~single[lead]]
        found.append((at, at + char[at], np.full(len(at), -1, np.int32)))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        place = (start - np.repeat(first, size + 1)[start]).astype(np.int16)
        order = np.argsort(place, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        gain = np.where(piece >= 0, score[piece], self.unk)
        best, back = np.full(len(text), -np.inf), np.zeros(len(text), np.int64)
        best[first] = 0
        a = 0
        for b in np.cumsum(np.bincount(place)).tolist():
            x, e = best[start[a:b]] + gain[a:b], end[a:b]
            up = np.flatnonzero(x > best[e])
            e = e[up]
            best[e], back[e] = x[up], a + up
            a = b
        steps, count, who, e = [], np.zeros(n, np.int64), np.arange(n), last
        while len(who):
            m = back[e]
            steps.append((who, m))
            count[who] += 1
            e = start[m]
            more = e > first[who]
            who, e = who[more], e[more]
        ends, taken = _ends(count), np.empty(int(count.sum()), np.int64)
        for k, (who, m) in enumerate(steps):
            taken[ends[who + 1] - 1 - k] = m
        ids = piece[taken]
        none = ids < 0
        if not none.any():
            return ids, count
        if not self.byte_id:
            return np.where(none, np.int32(self.unk_id), ids), count
        wide = np.where(none, end[taken] - start[taken], 1)
        to = _ends(wide)
        out, lone = np.repeat(ids, wide), np.flatnonzero(np.repeat(none, wide))
        out[lone] = np.array(self.byte_id, np.int32)[text[np.repeat(start[taken] - to[:-1], wide)[lone] + lone]]
        return out, np.diff(to[ends])

    def encode(self, text: str | None) -> list[int] | None:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Token ids of many texts."""
        ids, to = self.encode_column(pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
        ids, to = ids.tolist(), to.tolist()
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, to, to[1:])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts one after the other, and where each text's begin and end. The words of the texts are told apart
        by Arrow, and the ids of a word are looked up once for all its places; a null text has none."""
        texts = texts.cast(pa.large_binary())
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0))).fill_null(False)
        if odd.true_count:  # no if_else or replace_with_mask: the former garbles slices in pyarrow 23
            texts = pa.array([self._spaced(t) if x else t for t, x in zip(texts.to_pylist(), odd.to_pylist())], pa.large_binary())
        words = pc.split_pattern(texts, " ")
        to = _ends(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        words = words.flatten().dictionary_encode()
        codes = self._codes(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, size = _gather(self.pool, self.ends, codes[words.indices.to_numpy()])
        return ids, _ends(size)[to]

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """The places in the pool of the ids of distinct words. What is new is cut and segmented in one go."""
        if max(len(self.words), len(self.seen)) > self.room or len(self.pool) > 16 * self.room:
            self.forget()
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(codes < 0)
        if not len(at):
            return codes
        new = [words[k] for k in at.tolist()]
        chunks, many = self._cut(new)
        chunks = chunks.dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = np.fromiter(map(self.seen.get, names, repeat(-1)), np.int64, len(names))
        unseen = np.flatnonzero(parts < 0)
        fresh = [names[k] for k in unseen.tolist()]
        parts[unseen] = self._add(*self._segment(fresh))
        self._remember(self.seen, fresh, parts[unseen])
        parts = parts[chunks.indices.to_numpy()]
        got, more = parts[_ends(many)[:-1]], many > 1
        ids, size = _gather(self.pool, self.ends, parts[np.repeat(more, many)])
        got[more] = self._add(ids, np.diff(_ends(size)[_ends(many[more])]))
        self._remember(self.words, new, got)
        codes[at] = got
        return codes

    def _cut(self, words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all words, a marker before each, one after the other, and how many each word has: none goes on from a
        character of ``apart`` to another, or the other way, but markers go with what follows."""
        data = RAW_MARK + RAW_MARK.join(words)
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        byte = _ends(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000))
        begins = np.zeros(len(data) + 1, bool)
        kind = self.apart[points]
        begins[byte[1:-1][(kind[1:] != kind[:-1]) & (points[:-1] != ord(MARK))]] = True
        first = _ends(np.fromiter(map(len, words), np.int64, len(words)) + len(RAW_MARK))
        begins[first] = True
        at = np.flatnonzero(begins)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        return chunks, np.diff(np.searchsorted(at, first))

    @staticmethod
    def _remember(known: dict[bytes, int], words: list[bytes], codes: np.ndarray) -> None:
        known.update(zip(words, codes.tolist()))
        for w in words:
            if len(w) > WIDE:
                del known[w]

    def _add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The new places of ids that follow each other in runs of ``size``."""
        n = len(self.ends) - 1
        self.pool, self.ends = np.concatenate([self.pool, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        return np.arange(n, n + len(size))

    def forget(self) -> None:
        """Empties what is remembered: places in the pool by word and by chunk, and the pool, ids of one place after the other."""
        self.words: dict[bytes, int] = {}
        self.seen: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _spaced(text: bytes) -> bytes | None:
        """Words without the marker that stands before each, a space between; null if there are none."""
        if not text:
            return None
        return re.sub(b"(?<!%s)%s" % (RAW_MARK, RAW_MARK), b" ", RAW_MARK + text.replace(b" ", RAW_MARK))[1:]

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        try:
            text = "".join([self.text[i] for i in ids])
        except TypeError:  # byte pieces
            text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(2)
def _codec(model, scores: str) -> Codec:
    return Codec(list(model), scores)


def _loaded(spark: SparkSession, model: str, scores: str):
    """A broadcast of the vocabulary: bounded by the model file, some tens of thousands of pieces."""
    ship(spark)
    return spark.sparkContext.broadcast((tuple(read_pieces(model)), scores))


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of what is segmented together."""
    at = held = k = 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if k - at == STEP or (k > at and held + n > STEP_BYTES):
            yield at, k - at
            at, held = k, 0
        held += n
    if len(texts):
        yield at, k + 1 - at


def _lists(texts: pa.Array, ids: np.ndarray, to: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())


def _joined(table: pa.Array, ids: np.ndarray, to: np.ndarray) -> tuple[bytes, list[int]]:
    """What ``table`` has for all ids, joined, and where each text's begins and ends in it."""
    if not len(ids):
        return b"", [0] * len(to)
    _, ends, data = table.take(pa.array(ids)).buffers()
    return data.to_pybytes(), np.frombuffer(ends, np.int64)[to].tolist()


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new column ``ids`` (array<int>). A narrow step: no shuffle."""
    known = _loaded(docs.sparkSession, model, scores)

    @F.arrow_udf("array<int>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = _codec(*known.value)
        c.room = ROOM  # beside the stages before, whose memory the executor still has
        for texts in batches:
            parts = [texts.slice(*step) for step in _steps(texts)]
            yield pa.concat_arrays([_lists(t, *c.encode_column(t)) for t in parts] or [pa.array([], pa.list_(pa.int32()))])
        c.forget()

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, ids: str = "token_ids", text: str = "decoded", model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """``docs`` with the text of the token ids in a new column ``text``."""
    known = _loaded(docs.sparkSession, model, scores)

    @F.pandas_udf("string")
    def run(rows):
        c = _codec(*known.value)
        return rows.map(c.decode, na_action="ignore")

    return docs.withColumn(text, run(F.col(ids)))


SCHEMA = "doc_id bigint, token_ids array<int>, n_tokens bigint, n_byte_tokens bigint, tokens_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, model: str = MODEL, scores: str = "zipf", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass: ``doc_id, token_ids, n_tokens, n_byte_tokens, tokens_sha256``
    (lowercase hex of the ids as comma-joined decimals) and ``round_trip``, whether decoding gives the text again.
    Null text: nulls but for doc_id."""
    known = _loaded(docs.sparkSession, model, scores)

    def run(batches):
        c = _codec(*known.value)
        low, high = (c.byte_id[0], c.byte_id[255]) if c.byte_id else (0, -1)
        for batch in batches:
            for step in _steps(batch.column(1)):
                part = batch.slice(*step)
                texts = part.column(1)
                ids, to = c.encode_column(texts)
                nb = _ends((ids >= low) & (ids <= high))[to]
                listed, at = _joined(c.decimal, ids, to)
                sha = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]  # without the last comma
                back, at = _joined(c.spelled, ids, to)
                same = []
                for k, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                    alike = t is None or back[at[k] : at[k + 1]] == b" " + t
                    same.append(alike or c.decode(ids[to[k] : to[k + 1]].tolist()) == t.decode())
                null = texts.is_null().to_numpy(zero_copy_only=False)
                kinds = zip((np.diff(to), np.diff(nb), sha, same), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))
                rest = [pa.array(np.array(x), kind, mask=null) for x, kind in kinds]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(texts, ids, to), *rest],
                    ["doc_id", "token_ids", "n_tokens", "n_byte_tokens", "tokens_sha256", "round_trip"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, with the check that decoding gives the text again."""
    return encoded(table(spark, sf_dir, "documents"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last pipeline stage: documents with their token ids as new columns, named apart from those that are there. Null texts have null
    ids, empty ones none; repeated rows have the same. An empty table stays empty."""
    ids = clear_name(docs, "token_ids")
    out = encode(docs, ids=ids)
    return out.withColumn(clear_name(docs, "n_tokens"), F.size(ids).cast("bigint"))
