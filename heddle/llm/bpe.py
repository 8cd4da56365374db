"""Byte-pair encoding as a bounded-lookahead transducer, and its incremental decoder.

Encoding. A pre-token is read as a stream of symbols. From the merge list alone follows how far a merge decision
can depend on symbols to its right (``sufficient_lookahead``): G(t) is how many symbols past the end of a token t must be known to
be sure that t stands. Rules are taken in rank order; rule (l, r) -> lr can take an l away only when an r follows, so
G(l) becomes max(G(l), len(r) + G(r)), and lr stands when both parts did. The transducer encodes a window, emits the
tokens that end at least the largest G before the window's end, drops their symbols and reads on: its memory depends on the
merge list, not on the input. A token boundary is never merged over later, so restarting there is exact.

Batches of texts are cut into pre-tokens with array operations; a bounded memo keeps the ids of frequent pre-tokens.

Decoding. ``TextDecoder`` maps ids to their bytes and feeds a UTF-8 state machine that holds back at most three
bytes; malformed input gives U+FFFD. A vocabulary file without a decoder shows token strings joined by one space, as its library does;
they go through the same machine.

Defined cases. Null text: empty, no ids. The strings of added tokens in a text become those tokens' ids. Lone surrogates cannot
occur in Spark strings. Texts of any length are worked on in pieces cut at white space.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
from tokenizers import Regex, normalizers

SPACES = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: The contraction endings of the pre-tokenizer's pattern, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that neither compose nor reorder among each other and whose lower case no Unicode version since 5.0 has changed. A text of these alone is composed as it stands.
SETTLED = re.compile("[\x00-\u02ff\u0391-\u03c9\u0400-\u0481\u048a-\u0523\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u3001-\u301c\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*")
SPACE, LETTER, NUMBER, OTHER, UNSEEN = 0, 1, 2, 3, 255
#: Characters that are cut into pre-tokens at once. Equal pre-tokens among them are looked up once, so fewer, larger chunks spare most of the lookups.
CHUNK = 1 << 20


def byte_alphabet() -> list[str]:
    """Character for each byte: printable Latin-1 as it is, the others in order from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], sizes: dict[int, int]) -> int:
    """The largest number of symbols past a token's end on which that token can depend; merges are (left, right, new)."""
    reach = dict.fromkeys(sizes, 0)
    for left, right, new in merges:
        past_left, past_right = reach[left], reach[right]
        reach[new] = max(reach[new], past_right, past_left - sizes[right])
        reach[left] = max(past_left, sizes[right] + past_right)
        reach[right] = max(reach[right], past_left - sizes[right])
    return max(reach.values(), default=0)


class Vocabulary:
    """A byte-level BPE file of the ``tokenizers`` format: ids, merges, added tokens and lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.has_decoder = spec.get("decoder") is not None
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.back = {c: b for b, c in enumerate(letters)}
        sizes = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        rules = []
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            rule = (vocab[left], vocab[right], vocab[left + right])
            self.rank[rule[:2]] = (n, rule[2])
            rules.append(rule)
        self.lookahead = sufficient_lookahead(rules, sizes)
        self.sizes = sizes
        self.longest = max(sizes.values(), default=1)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def bytes_of(self, i: int) -> bytes:
        """The bytes that an id stands for; a word end adds a space."""
        token = self.tokens[i]
        if token in self.added and self.added[token] == i:
            return token.encode()
        ends = bool(self.suffix) and token.endswith(self.suffix)
        return bytes(self.back[c] for c in (token.removesuffix(self.suffix) if ends else token)) + b" " * ends


def merge_all(ids: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies the merges to a bounded list of symbols, lowest rank first and leftmost first."""
    none = (1 << 60, -1)
    found = [rank.get(p, none) for p in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best is none or best == none:
            break
        i = found.index(best)
        ids[i : i + 2] = [best[1]]
        del found[i]
        if i:
            found[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        if i < len(found):
            found[i] = rank.get((ids[i], ids[i + 1]), none)
    return ids


def transduce(symbols: Iterable[int], voc: Vocabulary) -> Iterator[int]:
    """Ids of one pre-token given as a stream of symbols; holds a window whose size follows from the merge list."""
    ahead = voc.lookahead
    full = ahead + max(voc.longest, ahead, 64)
    window: list[int] = []
    for s in symbols:
        window.append(s)
        if len(window) >= full:
            done = 0
            for t in merge_all(window.copy(), voc.rank):
                if done + voc.sizes[t] > len(window) - ahead:
                    break
                done += voc.sizes[t]
                yield t
            del window[:done]
    yield from merge_all(window, voc.rank)


class Encoder:
    """Encodes batches of texts; ``memo`` bounds how many pre-tokens are remembered."""

    def __init__(self, path: str, memo: int = 300_000):
        self.voc = Vocabulary(path)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = memo
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)
        self.kinds[SPACES] = SPACE
        self.form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.classes = {kind: normalizers.Replace(Regex(rf"\p{{{name}}}"), "") for kind, name in ((LETTER, "L"), (NUMBER, "N"))}

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = w.encode()
        voc = self.voc
        if len(raw) <= 64:
            inner = voc.inner
            ids = [inner[b] for b in raw]
            ids[-1] = voc.final[raw[-1]]
            return tuple(merge_all(ids, voc.rank))
        return tuple(transduce(chain((voc.inner[b] for b in raw[:-1]), (voc.final[raw[-1]],)), voc))

    def normal(self, text: str) -> str:
        """Composed form, lower case letter by letter (without the final-sigma rule).

        Compositions, the order of marks and classes of characters differ between versions of Unicode, so for all but settled texts they are asked from the library that the file is for.
        """
        if text.isascii():
            return text.lower()
        if SETTLED.fullmatch(text):
            return text.replace("Σ", "σ").lower()
        return self.form.normalize_str(text)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == UNSEEN).any():
            new = np.unique(points[kinds == UNSEEN])
            text = "".join(map(chr, new.tolist()))
            self.kinds[new] = OTHER
            for kind, drop in self.classes.items():
                left = drop.normalize_str(text)
                self.kinds[[ord(c) for c in set(text).difference(left)]] = kind
            kinds = self.kinds[points]
        return kinds

    def _spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens: letter runs, single numbers, runs of other marks, contractions."""
        kinds = self._kinds(points)
        n = len(points)
        solid, alone = kinds != SPACE, kinds == NUMBER
        change = np.ones(n + 1, bool)
        change[1:n] = (kinds[1:] != kinds[:-1]) | alone[1:]
        start, end = solid & change[:-1], solid & change[1:]
        quote = np.flatnonzero(start & end & (points == 39))
        for q in quote[quote < n - 1].tolist():
            after = "".join(map(chr, points[q + 1 : q + 3]))
            size = next((len(c) for c in CONTRACTIONS if after.startswith(c)), 0)
            if size:
                end[q] = start[q + 1] = False
                end[q + size] = True
                if q + size + 1 < n and kinds[q + size + 1] == LETTER:
                    start[q + size + 1] = True
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def _chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a normalised text, with each pre-token's start and number of ids."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        a, b = self._spans(points)
        if not len(a):
            return np.zeros(0, np.uint32), a, a
        v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        up, down = _powers(len(v))
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[: len(v)], out=sums[1:])
        h = (sums[b] - sums[a]) * down[a]
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        # A hash only groups; the letters decide. Whoever differs from its group's first goes on its own.
        wrong = self._unlike(points, a, b, one[back])
        back[wrong] = len(one) + np.arange(len(wrong))
        one = np.append(one, wrong)
        memo, runs = self.memo, []
        for i, j in zip(a[one].tolist(), b[one].tolist()):
            w = text[i:j]
            ids = memo.get(w)
            if ids is None:
                if len(memo) >= self.most:
                    memo.clear()
                ids = self.word(w)
                if j - i <= 64:
                    memo[w] = ids
            runs.append(ids)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter(chain.from_iterable(runs), np.uint32, int(sizes.sum()))
        count = sizes[back]
        at = (np.cumsum(sizes) - sizes)[back]
        ends = np.cumsum(count)
        return flat[np.repeat(at - ends + count, count) + np.arange(int(ends[-1]))], a, count

    @staticmethod
    def _unlike(points: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which pre-tokens a:b are not letter by letter the one at ``first``."""
        size = b - a
        even = size == size[first]
        some = np.flatnonzero(even & (first != np.arange(len(a))))
        n = size[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        other = points[np.repeat(a[some], n) + step] != points[np.repeat(a[first[some]], n) + step]
        return np.union1d(np.flatnonzero(~even), np.repeat(some, n)[other])

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        group: list[str] = []
        which: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not group:
                return
            lens = np.fromiter(map(len, group), np.int64, len(group)) + 1
            ids, at, count = self._chunk("\n".join(group))
            first = np.searchsorted(at, np.concatenate(([0], np.cumsum(lens))))
            ends = np.concatenate(([0], np.cumsum(count)))[first]
            for k, i in enumerate(which):
                out[i] = ids[ends[k] : ends[k + 1]]
            group.clear()
            which.clear()
            size = 0

        for i, t in enumerate(texts):
            t = t or ""
            if self.voc.split is not None and any(x in t for x in self.voc.added):
                parts = [p for p in self.voc.split.split(t) if p]
                out[i] = np.concatenate([np.array([self.voc.added[p]], np.uint32) if p in self.voc.added else self._whole(self.normal(p)) for p in parts] or [np.zeros(0, np.uint32)])
            elif len(t) > CHUNK:
                out[i] = self._whole(self.normal(t))
            else:
                group.append(self.normal(t))
                which.append(i)
                size += len(t)
                if size > CHUNK:
                    flush()
        flush()
        return out

    def _whole(self, text: str) -> np.ndarray:
        """A normalised text of any length, in pieces cut at white space."""
        parts, at = [], 0
        space = re.compile("[" + "".join(map(re.escape, map(chr, SPACES))) + "]")
        while at < len(text):
            m = space.search(text, at + CHUNK)
            to = m.start() if m else len(text)
            parts.append(self._chunk(text[at:to])[0])
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_power_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power_tables or len(_power_tables[0]) < n:
        pair = []
        for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)):
            p = np.full(max(n, 2 * CHUNK), base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _power_tables[:] = pair
    return _power_tables[0], _power_tables[1]


class TextDecoder:
    """Ids to text, block by block: at most three bytes of an unfinished character are held back between blocks.

    With ``shown`` the text is what the file's own library shows: token strings joined by one space where the file has no decoder.
    """

    def __init__(self, voc: Vocabulary, shown: bool = False):
        plain = shown and not voc.has_decoder
        self.table = [b""] * (max(voc.tokens) + 1)
        for i, t in voc.tokens.items():
            self.table[i] = t.encode() if plain else voc.bytes_of(i)
        self.gap = b" " if plain else b""

    def feed(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids, lead = iter(ids), b""
        while part := list(map(self.table.__getitem__, islice(ids, block))):
            if piece := machine.decode(lead + self.gap.join(part)):
                yield piece
            lead = self.gap
        if rest := machine.decode(b"", True):
            yield rest


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = 300_000) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, memo) not in _encoders:
        _encoders[path, memo] = Encoder(path, memo)
    return _encoders[path, memo]
