"""Byte-pair encoding kernels: re-merging, pair compatibility, prefix dynamic programming and backtracking.

Two facts carry both encoders. A token sequence is the encoding of its concatenation exactly if every adjacent pair,
merged again from scratch, comes back as that pair; and every prefix of a text therefore has exactly one possible last
token. Merge order is (priority, leftmost), so merges inside an interval happen in the same order whether or not the
rest of the text is there, which is why the check on pairs is enough.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np

#: White space of the pre-tokenisers' regular expressions (Unicode White_Space).
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680))) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters for which Python's tables and the libraries' surely agree; other texts are split by the library.
PLAIN = re.compile(f"[^\\x00-\\x1b -{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}{chr(0x2010)}-{chr(0x2027)}]")
CACHE = 300_000
PAIRS = 1_500_000


def _classes() -> tuple[str, str]:
    plain = [chr(i) for i in range(0x250) if i != 0x130]
    of = lambda kind: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)
    return of("L"), of("N")


def merge(symbols: list, best) -> list:
    """Plain merging: best(a, b) gives (priority, merged) or None; the lowest priority, then the leftmost pair, goes first."""
    symbols = list(symbols)
    while len(symbols) > 1:
        found = None
        for i in range(len(symbols) - 1):
            x = best(symbols[i], symbols[i + 1])
            if x is not None and (found is None or x[0] < found[0]):
                found = (x[0], i, x[1])
        if found is None:
            break
        symbols[found[1] : found[1] + 2] = [found[2]]
    return symbols


class PrefixCounter:
    """Token counts of a byte-level BPE at every prefix, by dynamic programming over prefixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        to_byte = _byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.vocab = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.merges.setdefault((a, b), (rank, a + b))
        self.suffixes: dict[bytes, int] = {}
        for b, i in self.vocab.items():
            self.suffixes[b] = i
        for b in self.vocab:
            for j in range(1, len(b)):
                self.suffixes.setdefault(b[j:], -1)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        letters, numbers = _classes()
        tail = lambda L, N: rf"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{_not(L, N)}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.plain_split = re.compile(tail(f"[{letters}]", f"[{numbers}]"))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.totals: dict[str, int] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, merged again from their bytes, stay a and b; a = -1: whether b alone is its own encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self.bytes_of.get(a, b""), self.bytes_of[b]
            again = merge([bytes([x]) for x in left + right], lambda x, y: self.merges.get((x, y)))
            known = again == ([left, right] if left else [right])
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Token count of every prefix of one pre-token, from the empty one on."""
        counts, last = [0], [-1]
        suffixes, compatible = self.suffixes, self.compatible
        for end in range(1, len(piece) + 1):
            for start in range(end - 1, -1, -1):
                token = suffixes.get(piece[start:end])
                if token is None:  # no token ends with these bytes, so none ends with more of them
                    start = -1
                    break
                if token >= 0 and counts[start] >= 0 and compatible(last[start], token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                start = -1
            if start < 0 and len(counts) == end:
                raise ValueError("a prefix without an encoding: the vocabulary lacks a byte")
        return counts

    def split(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand alone."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._split(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out.extend([part] if k % 2 else self._split(part))
        return out

    def _split(self, text: str) -> list[str]:
        if PLAIN.search(text) is None:
            return self.plain_split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pieces: list[str]) -> list[int]:
        """Token count of each pre-token."""
        totals = self.totals
        if len(totals) > CACHE:
            totals.clear()
        for p in set(pieces).difference(totals):
            totals[p] = 1 if p in self.specials else self.prefixes(p.encode())[-1]
        return list(map(totals.__getitem__, pieces))

    def count(self, text: str) -> int:
        return sum(self.lengths(self.split(text)))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Answers about prefixes of one text without encoding it again: pre-token starts, counts before each, and counts inside."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.pieces = counter.split(text)
        self.starts, self.before, at, n = [], [], 0, 0
        for p, k in zip(self.pieces, counter.lengths(self.pieces), strict=True):
            self.starts.append(at)
            self.before.append(n)
            at, n = at + len(p), n + k
        self.total = n

    def __call__(self, k: int) -> int:
        """Token count of text[:k]. Cutting can change only the last pre-token, white space before it, or a cut special string."""
        import bisect

        if k <= 0:
            return 0
        if k >= len(self.text):
            return self.total
        m = bisect.bisect_right(self.starts, k - 1) - 1
        if self.starts[m] + len(self.pieces[m]) == k and (m + 1 == len(self.pieces) or not self.pieces[m].isspace()):
            return self.before[m] + self.counter.lengths([self.pieces[m]])[0]
        s = m
        if self.pieces[s] in self.counter.specials and s:
            s -= 1
        if s and self.pieces[s - 1].isspace():
            s -= 1
        if s == m and len(self.pieces[m]) > 64:  # a long run of one class: its prefixes are pre-tokens too
            cut = self.text[self.starts[m] : k]
            return self.before[m] + self.inner(m)[len(cut.encode())]
        return self.before[s] + self.counter.count(self.text[self.starts[s] : k])

    def inner(self, m: int) -> list[int]:
        if getattr(self, "_inner", (None,))[0] != m:
            self._inner = (m, self.counter.prefixes(self.pieces[m].encode()))
        return self._inner[1]

    def longest(self, budget: int) -> int:
        """Most characters k with at most budget tokens in text[:k]."""
        import bisect

        if self.total <= budget:
            return len(self.text)
        m = bisect.bisect_right(self.before, budget) - 1
        k = self.starts[m] + len(self.pieces[m])
        while k and self(k) > budget:
            k -= 1
        return k


def _not(letters: str, numbers: str) -> str:
    inner = letters[1:-1] + numbers[1:-1]
    return f"[^{SPACE}{inner}]"


@lru_cache(maxsize=1)
def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in own}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))})
    return out


class PieceCodec:
    """A SentencePiece model of merge type: exact encoding by backtracking, and decoding."""

    MARK = "\u2581"

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep text as it is are supported")
        kinds = proto.ModelProto.SentencePiece
        self.dummy = norm.add_dummy_prefix
        self.bos, self.eos, self.unk = model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.fallback = model.trainer_spec.byte_fallback
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.piece = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw: list[bytes] = []
        for p in model.pieces:
            if p.type == kinds.BYTE:
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                self.raw.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.raw.append(model.trainer_spec.unk_surface.encode())
            else:
                self.raw.append(p.piece.replace(self.MARK, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = "".join(re.escape(p) for p in self.ids if len(p) == 1 and p != self.MARK)
        # no piece has the mark after another character, and no piece holds an unknown one: there the text falls apart
        crosses = any(self.MARK in p.lstrip(self.MARK) for p in self.ids)
        self.parts = re.compile(f"[{known}{self.MARK}]+|[^{known}{self.MARK}]" if crosses else f"{self.MARK}*[{known}]+|{self.MARK}+|[^{known}{self.MARK}]", re.S)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            again = merge(list(a + b), lambda x, y: (-self.score[x + y], x + y) if x + y in self.score else None)
            found = again == ([a, b] if a else [b])
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def backtrack(self, part: str) -> list[str]:
        """Longest match first; where a token doesn't go with the one before, the next shorter match; positions from which nothing fits are marked."""
        n = len(part)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(part):
            at[end - len(piece) + 1].append(piece)
        for x in at:
            x.sort(key=len, reverse=True)
        failed = bytearray(n + 1)
        tokens: list[str] = []
        tried: list[int] = [0]
        pos = 0
        while pos < n:
            k, matches, last = tried[-1], at[pos], tokens[-1] if tokens else ""
            while k < len(matches) and (failed[pos + len(matches[k])] or not self.compatible(last, matches[k])):
                k += 1
            if k < len(matches):
                tried[-1] = k
                tokens.append(matches[k])
                pos += len(matches[k])
                tried.append(0)
            else:
                if not tokens:
                    raise ValueError("no encoding")
                failed[pos] = 1
                tried.pop()
                pos -= len(tokens.pop())
        return tokens

    def _part(self, part: str) -> tuple[int, ...]:
        if part[0] in self.ids:
            return tuple(self.ids[p] for p in self.backtrack(part))
        return tuple(self.byte_id[b] for b in part.encode()) if self.fallback else (self.unk,)

    def encode(self, text: str, ends: bool = True) -> list[int]:
        out = [self.bos] if ends else []
        if text:
            parts = self.parts.findall((self.MARK if self.dummy else "") + text.replace(" ", self.MARK))
            known = self.known
            if len(known) > CACHE:
                known.clear()
            for p in set(parts).difference(known):
                known[p] = self._part(p)
            for ids in map(known.__getitem__, parts):
                out += ids
        if ends:
            out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.dummy:  # the space that encoding put in front goes again
            first = next((i for i in ids if i not in (self.bos, self.eos)), None)
            if first is not None and self.piece[first].startswith(self.MARK):
                raw = raw[1:]
        return raw.decode("utf-8", "gleaner-each")


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


import codecs  # noqa: E402

codecs.register_error("gleaner-each", _each)


class WordEncoder:
    """Ids of a tokenizers file that drops white space and ends every word by a suffix: each distinct run between white
    space is encoded once by the library, many in one call, and told apart by the tokens that end words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)  # for words that are normalised and split already
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        steps = [n["type"] for n in ((spec["normalizer"] or {}).get("normalizers") or [])]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        suffix = spec["model"].get("end_of_word_suffix")
        self.fast = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        if self.fast:
            letters, numbers = _classes()
            pattern = splits[0]["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", _not(f"[{letters}]", f"[{numbers}]")).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
            self.fast = r"\p" not in pattern and r"\s" not in pattern
            self.split = re.compile(pattern)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Free what was learned: between tasks a worker is idle and its memory is better used elsewhere."""
        self.known, self.old = {}, {}

    def _learn(self, new: list[str]) -> None:
        """Every run gets its ids as bytes: all their words go through the library at once, and the tokens that end words tell them apart."""
        known, old = self.known, self.old
        rest = []
        for w in new:
            ids = old.get(w)
            if ids is None:
                rest.append(w)
            else:
                known[w] = ids
        if len(known) > 2 * CACHE:
            self.old, self.known = known, {w: known[w] for w in new if w in known}
            known = self.known
        if not rest:
            return
        parts = [[w] if w.isalpha() else self.split.findall(w) for w in rest]
        ids = np.array(self.words.encode_batch_fast([" ".join(itertools.chain.from_iterable(parts))], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        sizes = np.cumsum([len(x) for x in parts])
        if len(ends) == sizes[-1]:
            raw, at = ids.tobytes(), [0, *(4 * ends[sizes - 1]).tolist()]
            for k, w in enumerate(rest):
                known[w] = raw[at[k] : at[k + 1]]
        else:
            for w in rest:
                known[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.fast or PLAIN.search(text) is not None or any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        runs = text.lower().split()
        known = self.known
        new = [w for w in runs if w not in known]
        if new:
            self._learn(list(dict.fromkeys(new)))
            if self.known is not known:  # a new generation began
                known = self.known
                again = [w for w in runs if w not in known]
                if again:
                    known.update((w, ids) for w in again if (ids := self.old.get(w)) is not None)
        return np.frombuffer(b"".join(map(known.__getitem__, runs)), "<u4")


@lru_cache(maxsize=8)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@lru_cache(maxsize=8)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


@lru_cache(maxsize=8)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
