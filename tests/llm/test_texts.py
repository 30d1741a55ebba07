"""Token counts, pieces, packing, language-model scores: against the libraries and brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import bpe, lm_scoring, packing, pieces, token_counts

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = st.text(st.one_of(st.sampled_from("ab etoThinsE019'.,!  \n\t▁é"), st.characters(codec="utf-8")), max_size=60)


def sized(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_match_library(odd, texts):
    library = Tokenizer.from_file(BYTE)
    got = sorted(tuple(r) for r in token_counts.token_counts(odd, BYTE, 50).collect())
    want = []
    for d, t in texts:
        n = sized(library, t)
        fit = max(k for k in range(len(t) + 1) if sized(library, t[:k]) <= 50) if 50 < n and len(t) < 900 else None
        want.append((d, len(t.encode()), n, n > 50, len(t.encode()) if n <= 50 else fit if fit is None else len(t[:fit].encode())))
    for a, b in zip(got, sorted(want, key=lambda x: x[:4]), strict=True):
        assert a[:4] == b[:4] and (b[4] is None or a[4] == b[4])


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_every_prefix(text):
    counter = bpe.prefix_counter(BYTE)
    table = counter.table(text)
    for k in range(len(text) + 1):
        assert table(k) == sized(counter.library, text[:k])


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_pieces_match_library(text):
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECE), bpe.piece_codec(PIECE)
    ids = codec.encode(text)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_words_match_library(text):
    encoder = bpe.word_encoder(WORD)
    assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_piece_queries(odd, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for d, t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in pieces.piece_digests(odd, PIECE).collect()) == sorted(want)
    back = pieces.decode_pieces(pieces.encode_pieces(odd, PIECE), PIECE)
    assert sorted(tuple(r) for r in back.collect()) == sorted((d, library.decode(library.encode(t))) for d, t in texts)


def test_packing(odd, texts):
    library, capacity = Tokenizer.from_file(WORD), 64
    rows = packing.pack_documents(odd, WORD, capacity=capacity).collect()
    want = Counter()
    for d, t in texts:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            want[d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in slots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(slots) == packing.plan(Counter(r["length"] for r in rows), capacity)[1]
    assert len(slots) <= math.ceil(sum(r["length"] for r in rows) / capacity) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), min_size=1))
def test_plan_is_best_fit_decreasing(histogram):
    rows, sequences = packing.plan(histogram, 20)
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((k for k in range(len(room)) if room[k] >= length), key=lambda k: room[k], default=None)
            if fit is None:
                room.append(20)
                fit = len(room) - 1
            room[fit] -= length
    assert sequences == len(room)
    placed = Counter()
    for length, rank, first, offset, many in rows.tolist():
        for k in range(many):
            for b in range(offset, offset + length):
                placed[first + k, b] += 1
        assert 0 <= rank
    assert max(placed.values()) == 1 and len(placed) == sum(n * c for n, c in histogram.items())


def segmentations(word, logs):
    """The plain sum over all ways to cut a word into pieces."""
    ways = [1.0] + [0.0] * len(word)
    for i in range(1, len(word) + 1):
        ways[i] = sum(ways[j] * math.exp(logs[word[j:i]]) for j in range(i) if word[j:i] in logs)
    return ways[-1]


def test_lattice_is_the_sum_over_segmentations():
    v = lm_scoring.vocabulary(PIECE)
    logs = dict(zip(v.pieces, v.first, strict=True))
    for word in ("the", "quick", "aé", "zzzz", "中文"):
        raw = lm_scoring.MARK + word.encode()
        chars = np.frombuffer(raw, np.uint8)[None]
        assert math.isclose(math.exp(v.forward(chars, v.first)[0, -1]), segmentations(raw, logs), rel_tol=1e-9)
        uses = v.expected(chars, v.first, np.ones(1))
        assert math.isclose(sum(len(p) * u for p, u in zip(v.pieces, uses, strict=True)), len(raw), rel_tol=1e-9)


@pytest.mark.parametrize("hot", [5, 100_000])
def test_scores(odd, texts, hot):
    rows = lm_scoring.score_documents(odd, PIECE, hot=hot).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in texts if not held(d) for w in t.encode().lower().split())
    ends = sum(not held(d) for d, _ in texts)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for d, t in texts:
        w = t.encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)))
    assert sorted((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows) == sorted(want)
    assert all(r["score"] < 0 for r in rows)


def test_empty_tables(nothing):
    for out in (token_counts.token_counts(nothing, BYTE), pieces.piece_digests(nothing, PIECE), packing.pack_documents(nothing, WORD), lm_scoring.score_documents(nothing, PIECE)):
        assert out.count() == 0
