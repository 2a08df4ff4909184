"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding. A token of the output is *stable* once no further input can change it. For a merge list, the distance from
the end of the input at which every token is stable is bounded; `sufficient_lookahead` computes such a bound. Text is
taken block by block. Words whose end is certain are merged at once (a bounded cache remembers frequent ones); a word
without an end in sight is merged in a sliding window, and its tokens are emitted as soon as they lie further from the
window's end than the lookahead. Memory is constant in the length of text and word alike.

Decoding. Tokens become bytes and bytes become text in an incremental UTF-8 state machine that carries at most three
bytes from one feed to the next and puts U+FFFD for what is not UTF-8.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array

import regex

#: The pre-tokenizer's pattern of byte-level BPE, and the characters that Unicode calls white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

_S = "[" + SPACE + "]"
_WORDS = regex.compile(WORD.replace(r"[^\s", "[^" + SPACE).replace(r"(?!\S)", "(?![^" + SPACE + "])").replace(r"\s", _S))
_BOUNDARY = regex.compile(" (?=[^" + SPACE + "])")
_ODD = regex.compile(" [" + SPACE + "]")
#: How a word that has begun goes on, by the kind of its last character.
_GOES_ON = [(regex.compile(x), regex.compile(x + "*+")) for x in (r"\p{L}", r"\p{N}", _S, "[^" + SPACE + r"\p{L}\p{N}]")]

BLOCK = 1 << 16
CACHE_WORDS = 300_000
CACHED_WORD = 64
#: The contractions are three characters at most, so a later character can change no word but those that start in the last three.
_HELD = 3


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level merge list: ids, ranks and the lookahead that suffices for it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, model = _byte_letters(), whole["model"]
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.token_bytes.items()}
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.rank_of: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[bytes(letters[c] for c in t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[self.token_bytes[left] + self.token_bytes[right]]
            self.rank_of[left << 32 | right] = rank
            self.rules.append((left, right, made))
        self.lookahead = sufficient_lookahead(self.rules, {i: len(b) for i, b in self.token_bytes.items()})
        self.longest = max(map(len, self.token_bytes.values()))

    def merge(self, word: bytes) -> list[int]:
        """The tokens of one whole word: the pair of least rank first, the leftmost of equals."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > 48:
            return self._merge_long(parts)
        rank_of, none = self.rank_of, len(self.rules)
        ranks = [rank_of.get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            made = parts[i] = self.rules[rank][2]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(parts[i - 1] << 32 | made, none)
            if i < len(ranks):
                ranks[i] = rank_of.get(made << 32 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, in O(n log n)."""
        n, rank_of = len(parts), self.rank_of
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            left, right, made = self.rules[rank]
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (rank := rank_of.get(made << 32 | parts[after[j]])) is not None:
                    heapq.heappush(heap, (rank, i))
            if (k := before[i]) >= 0 and (rank := rank_of.get(parts[k] << 32 | made)) is not None:
                heapq.heappush(heap, (rank, k))
        return [x for x in parts if x >= 0]


def sufficient_lookahead(rules: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes from the end of the input beyond which further input changes no token.

    Compare the merges of a word with those of the word and a continuation. Left of some boundary both have the same
    tokens. It moves left only when a rule (u, v) is applied across it in one of both, by the length of u, and each rule
    moves it once, as rules are applied in order. v is then a token that starts at the boundary in one of both: it grew
    (as a left operand) from the u or the uv of the rule that moved the boundary before. So the furthest that rule j
    reaches is len(u) plus the reach of an earlier rule whose u or uv lies on the left spine of v, or else len(v) - 1,
    the part of v that the first difference may take from the input. The bound is the largest reach.
    """
    made_by: dict[int, tuple[int, int]] = {}
    reach_made: dict[int, int] = {}
    reach_left: dict[int, int] = {}
    most = 0
    for left, right, made in rules:
        best, x = length[right] - 1, right
        while True:
            best = max(best, reach_made.get(x, 0), reach_left.get(x, 0))
            if x not in made_by:
                break
            x = made_by[x][0]
        reach = length[left] + best
        made_by[made] = left, right
        reach_made[made] = max(reach, reach_made.get(made, 0))
        reach_left[left] = max(reach, reach_left.get(left, 0))
        most = max(most, reach)
    return most


class _Words(dict):
    """Ids of words as packed unsigned 32-bit integers; a chunk (a space and what follows up to the next) is one or more words."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, chunk: str) -> bytes:
        out = []
        for word in _WORDS.findall(chunk):
            out += self.merges.merge(word.encode())
        packed = array("I", out).tobytes()
        if len(chunk) <= CACHED_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = packed
        return packed


class _Window:
    """One word that comes in parts: tokens leave once they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.size = merges, bytearray(), max(4 * merges.lookahead, 2048)

    def feed(self, data: bytes, out: array) -> None:
        for at in range(0, len(data), self.size):
            self.held += data[at : at + self.size]
            if len(self.held) < self.size:
                continue
            tokens, end, stable = self.merges.merge(bytes(self.held)), 0, len(self.held) - self.merges.lookahead
            for t in tokens:
                size = len(self.merges.token_bytes[t])
                if end + size > stable:
                    break
                out.append(t)
                end += size
            del self.held[:end]

    def finish(self, out: array) -> None:
        out.extend(self.merges.merge(bytes(self.held)))
        self.held.clear()


class Encoder:
    """Streaming encoder. feed() text in blocks of any size and take ids as they become stable; finish() gives the rest."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words = _Words(merges)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.longest_special = max(map(len, merges.special), default=0)
        self._reset()

    def _reset(self) -> None:
        self.raw, self.text, self.open, self.goes_on = "", "", None, None

    def _chunks(self, text: str, out: list[bytes]) -> None:
        """Text that ends where a word ends for certain."""
        if not text:
            return
        if _ODD.search(text) is None:
            first, *rest = text.split(" ")
            if rest and rest[-1] == "":
                rest.pop()
                tail = [" "]
            else:
                tail = []
            chunks = [first] * bool(first) + [" " + x for x in rest] + tail
        else:
            cuts = [m.start() for m in _BOUNDARY.finditer(text)]
            chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]
        if max(map(len, chunks)) <= 1024:
            out.append(b"".join(map(self.words.__getitem__, chunks)))
            return
        for chunk in chunks:
            if len(chunk) <= 1024:
                out.append(self.words[chunk])
                continue
            ids = array("I")
            for word in _WORDS.finditer(chunk):
                window = _Window(self.merges)
                window.feed(word.group().encode(), ids)
                window.finish(ids)
            out.append(ids.tobytes())

    def _plain(self, more: str, out: list[bytes]) -> None:
        """Text without special tokens; what may still change stays in self.text, or in the window of the open word."""
        text = self.text + more
        if self.open is not None:
            end = self.goes_on.match(text).end()
            keep = end if end < len(text) else max(0, len(text) - _HELD)
            if self.goes_on is _GOES_ON[2][1]:
                keep = max(0, end - 1) if end < len(text) else keep
            ids = array("I")
            self.open.feed(text[:keep].encode(), ids)
            text = text[keep:]
            if end < len(self.text) + len(more):
                self.open.finish(ids)
                self.open = None
            out.append(ids.tobytes())
            if self.open is not None:
                self.text = text
                return
        cut = text.rfind(" ", 0, len(text) - 1)
        while cut >= 0 and text[cut + 1] in SPACE:
            cut = text.rfind(" ", 0, cut)
        if cut > 0:
            self._chunks(text[:cut], out)
            text = text[cut:]
        if len(text) > 2 * _HELD + 1024:
            done, last = 0, None
            ids = array("I")
            for last in _WORDS.finditer(text):
                if last.end() >= len(text) - _HELD:
                    break
                window = _Window(self.merges)
                window.feed(last.group().encode(), ids)
                window.finish(ids)
                done = last.end()
            text = text[done:]
            if len(text) > 2 * _HELD + 1024:
                self.goes_on = next(many for one, many in _GOES_ON if one.match(text[1]))
                self.open = _Window(self.merges)
                keep = len(text) - _HELD
                self.open.feed(text[:keep].encode(), ids)
                text = text[keep:]
            out.append(ids.tobytes())
        self.text = text

    def _end(self, out: list[bytes]) -> None:
        if self.open is not None:
            text, ids = self.text, array("I")
            end = self.goes_on.match(text).end()
            if self.goes_on is _GOES_ON[2][1] and end < len(text):
                end = max(0, end - 1)
            self.open.feed(text[:end].encode(), ids)
            self.open.finish(ids)
            out.append(ids.tobytes())
            self.open, self.text = None, text[end:]
        self._chunks(self.text, out)
        self.text = ""

    def feed(self, block: str) -> bytes:
        """Ids (packed, 32 bits each) that are stable after this block."""
        out: list[bytes] = []
        if self.specials is None:
            self._plain(block, out)
            return b"".join(out)
        raw = self.raw + block
        if all(x[0] not in raw for x in self.merges.special):
            self.raw = ""
            self._plain(raw, out)
            return b"".join(out)
        *parts, last = self.specials.split(raw)
        for part in parts:
            if part in self.merges.special:
                self._end(out)
                out.append(array("I", [self.merges.special[part]]).tobytes())
            else:
                self._plain(part, out)
        keep = next((k for k in range(min(len(last), self.longest_special - 1), 0, -1) if any(x.startswith(last[-k:]) for x in self.merges.special)), 0)
        self.raw = last[len(last) - keep :]
        self._plain(last[: len(last) - keep], out)
        return b"".join(out)

    def finish(self) -> bytes:
        """The remaining ids; the encoder is then ready for another text."""
        out: list[bytes] = []
        self._plain(self.raw, out)
        self._end(out)
        self._reset()
        return b"".join(out)

    def stream(self, text: str):
        """The packed ids of a whole text, block by block."""
        try:
            for at in range(0, len(text), BLOCK):
                yield self.feed(text[at : at + BLOCK])
            yield self.finish()
        finally:  # a text that is given up leaves nothing behind
            self.open = None
            self._reset()

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        return b"".join(self.stream(text))


class Decoder:
    """Incremental decoder: feed() ids and take the text that is complete; finish() gives U+FFFD for a torn character."""

    def __init__(self, merges: Merges):
        self.bytes = merges.token_bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Merges(path))
    return _LOADED[path]
