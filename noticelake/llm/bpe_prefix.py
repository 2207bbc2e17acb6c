"""Byte-level BPE by dynamic programming over prefixes, and back.

The encoding of a text's prefix ends in exactly one token, and what stands before that token is the encoding of the
shorter prefix. So one token per prefix is enough: of the tokens that end at a place, found by a suffix automaton of the
vocabulary, the one that is compatible with the token stored for the prefix before it. Back-pointers then give the ids.

Two neighbouring tokens are compatible when merging the bytes of both gives just these two: no merge across the border
comes up while its two sides stand there. Only the parts that touch the border matter, the right edge of the left token's
merge tree and the left edge of the right one's.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import texts

# Fixed values, as the vocabulary format has them: characters with the Unicode property White_Space, and the pieces that a
# text is cut into before merging.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

NEVER = 1 << 62


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable ones of Latin-1 for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SuffixAutomaton:
    """Of several strings: all their substrings as paths from state 0. ``go`` is keyed by ``state << 8 | byte``."""

    def __init__(self):
        self.go: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]

    def add(self, string: bytes) -> int:
        """Enter a string and return its state, of which it is the longest."""
        state = 0
        for byte in string:
            state = self._extend(state, byte)
        return state

    def _new(self, length: int) -> int:
        self.out.append([])
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, at: int, byte: int, old: int) -> int:
        """A state for the strings of ``old`` that are no longer than those of ``at`` with ``byte``."""
        new = self._new(self.length[at] + 1)
        for b in self.out[old]:
            self.go[new << 8 | b] = self.go[old << 8 | b]
        self.out[new] = list(self.out[old])
        self.link[new] = self.link[old]
        self.link[old] = new
        while at >= 0 and self.go.get(at << 8 | byte) == old:
            self.go[at << 8 | byte] = new
            at = self.link[at]
        return new

    def _extend(self, last: int, byte: int) -> int:
        known = self.go.get(last << 8 | byte)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, byte, known)
        new, at = self._new(self.length[last] + 1), last
        while at >= 0 and (at << 8 | byte) not in self.go:
            self.go[at << 8 | byte] = new
            self.out[at].append(byte)
            at = self.link[at]
        if at >= 0:
            met = self.go[at << 8 | byte]
            self.link[new] = met if self.length[met] == self.length[at] + 1 else self._clone(at, byte, met)
        return new


class PrefixEncoder:
    """A byte-level BPE vocabulary file as an automaton and merge trees. Raises ValueError for any other kind of file."""

    def __init__(self, path: str, limit: int = 250_000):
        import regex

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        model, cut = plan["model"], plan.get("pre_tokenizer") or {}
        plain = plan.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
        unusual = ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not plain or not cut.get("use_regex", True) or any(model.get(k) for k in unusual):
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = plan.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.spaces = regex.compile(rf" (?=[^{SPACE}])")

        at_byte, vocabulary = byte_characters(), model["vocab"]
        content = {i: bytes(at_byte[c] for c in t) for t, i in vocabulary.items()}
        self.bytes_of = [b""] * (1 + max([*content, *self.special.values()]))
        for i, b in content.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.packed = [array("i", [i]).tobytes() for i in range(len(self.bytes_of))]
        self._plant(model["merges"], vocabulary, content)
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def _plant(self, merges: list, vocabulary: dict[str, int], content: dict[int, bytes]) -> None:
        """Merge trees, and the automaton over all tokens that merging can arrive at."""
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocabulary[left], vocabulary[right]
            self.rank[a, b] = rank
            parts.setdefault(vocabulary[left + right], (a, b, rank))
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for token in sorted(content, key=lambda t: len(content[t])):
            if token in parts:
                a, b, rank = parts[token]
                if any(p in parts and parts[p][2] > rank for p in (a, b)):
                    raise ValueError("a merge comes before one of its parts")
                grown = {}
                for side, part in (("left", a), ("right", b)):
                    (whole, _), *inner = getattr(self, side)[part]
                    grown[side] = [(token, NEVER), (whole, rank), *inner]
                self.left[token], self.right[token] = grown["left"], grown["right"]
            else:
                self.left[token] = self.right[token] = [(token, NEVER)]
        automaton = SuffixAutomaton()
        state_of = {}
        for token, string in content.items():
            reached = len(string) == 1 or (token in parts and self._stand(*parts[token][:2], parts[token][2]))
            if reached:
                state_of[token] = string
        # A string's state moves when a later one splits it: look them up when all are entered.
        for string in state_of.values():
            automaton.add(string)
        self.go, self.link, self.length = automaton.go, automaton.link, automaton.length
        own = [-1] * len(self.link)
        for token, string in state_of.items():
            state = 0
            for byte in string:
                state = self.go[state << 8 | byte]
            own[state] = token
        # The longest token among a state's strings and their suffixes; and the next shorter one that ends a token.
        self.longest, self.shorter = own, [-1] * len(self.bytes_of)
        for state in sorted(range(1, len(own)), key=self.length.__getitem__):
            up = own[self.link[state]]
            if own[state] >= 0:
                self.shorter[own[state]] = up
            else:
                own[state] = up
        self.size = [len(b) for b in self.bytes_of]

    def _stand(self, a: int, b: int, but: int = -1) -> bool:
        """Whether no merge (but the one of rank ``but``) crosses the border between two tokens while they are put together.

        Of equal merges the left one is first: one inside ``a`` goes ahead of the border, the border ahead of one in ``b``.
        """
        rank = self.rank
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                m = rank.get((x, y))
                if m is not None and m != but and m < until_x and m <= until_y:
                    return False
        return True

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each piece. Sorted, so that a piece starts from the prefixes it shares with the one before."""
        go, link, length, longest = self.go, self.link, self.length, self.longest
        shorter, size, packed, fits, stand = self.shorter, self.size, self.packed, self.fits, self._stand
        if len(fits) > 1_000_000:
            fits.clear()
        room = 1 + max(map(len, pieces), default=0)
        states, matched, last = [0] * room, [0] * room, [-1] * room
        before, out = b"", {}
        for piece in sorted(pieces):
            most, i = min(len(before), len(piece)), 0
            while i < most and before[i] == piece[i]:
                i += 1
            state, n = states[i], matched[i]
            for byte in piece[i:]:
                to = go.get(state << 8 | byte)
                while to is None:
                    state = link[state]
                    n = length[state]
                    to = go.get(state << 8 | byte)
                state = to
                n += 1
                i += 1
                token = longest[state]
                if size[token] > n:
                    token = shorter[token]
                while j := i - size[token]:
                    pair = last[j] << 17 | token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = stand(last[j], token)
                    if good:
                        break
                    token = shorter[token]
                states[i] = state
                matched[i] = n
                last[i] = token
            ids = packed[last[i]]
            i -= size[last[i]]
            while i:
                ids = packed[last[i]] + ids
                i -= size[last[i]]
            out[piece] = ids
            before = piece
        return out

    def _learn(self, words: list[str]) -> None:
        """Words are texts cut ahead of single blanks, where a piece always begins; they are remembered up to a limit."""
        cut = {w: [p.encode() for p in self.pieces.findall(w)] for w in words}
        ids = self.encode_pieces(list({p for pieces in cut.values() for p in pieces}))
        for word, pieces in cut.items():
            self.words[word] = b"".join([ids[p] for p in pieces])

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Added tokens spelled in a text become their own ids."""
        if len(self.words) > self.limit:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        plans: list[list[str | int]] = []
        for text in docs:
            plan: list[str | int] = []
            for part in self.specials.split(text) if self.specials and self.specials.search(text) else (text,):
                if part in self.special:
                    plan.append(self.special[part])
                elif part:
                    head, *rest = self.spaces.split(part)
                    if head:
                        plan.append(head)
                    plan += [" " + w for w in rest]
            plans.append(plan)
        new = []
        for word in {w for plan in plans for w in plan}:
            if word not in words:
                if isinstance(word, int):
                    words[word] = self.packed[word]
                elif (known := older.get(word)) is not None:
                    words[word] = known
                else:
                    new.append(word)
        self._learn(new)
        get = words.__getitem__
        return [b"".join(map(get, plan)) for plan in plans]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of a sequence of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        table, n = self.bytes_of, len(self.bytes_of)
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= n:
            numbers = numbers[numbers < n]
        found = b"".join(map(table.__getitem__, numbers.tolist()))
        return found if found.isascii() else found.decode("utf-8", "replace").encode()


def by_size(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(np.fromiter(map(len, (t or b"" for t in texts(batch))), np.int64, batch.num_rows))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_KNOWN: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The vocabulary as this Python process has built it: its next tasks use it too."""
    if path not in _KNOWN:
        _KNOWN[path] = PrefixEncoder(path)
    return _KNOWN[path]


def encode_texts(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, and with ``decode`` the text that the ids spell, ``decoded``.

    ``ids`` is binary: unsigned 32-bit integers, little-endian. NULL and empty texts have none; NULL ids, repeated rows and
    equal ids each keep their row; other columns are left out. Rows never meet: there is no shuffle, and a task holds the
    vocabulary, the words lately met up to a limit and a few megabytes of text, or one text if it is longer.
    """
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for whole in batches:
            for batch in by_size(whole):
                ids = known.encode([(t or b"").decode("utf-8", "replace") for t in texts(batch)])
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                columns = [batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(map(known.decode, ids), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids`` as :func:`encode_texts` gives them; NULL ids spell the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            found = [known.decode(b or b"") for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "text"]
            )

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
