"""Exact token counts at every prefix (operator 9).

The counts are those of a BPE vocabulary with word ends (lower case, white space
dropped), as the tokenizers library gives them. For words, dynamic programming
goes over their prefixes: a sequence of tokens is the encoding of its text just when each
neighbouring pair is the encoding of the pair's text, so the encoding of a
prefix is that of a shorter one and one more token that fits its last. It goes over many words at once, place by place. The counts of
all prefixes of a word are stored per worker (bounded), those of a text are put together from its words'
and a running sum. Totals, truncation and budget questions are read from these tables; nothing is encoded again.

Prefixes are counted in code points of the text as given. The vocabulary composes characters (NFC) and lowers their case; a prefix that ends inside a
composed character or a special token's string is counted as the text it is, but the longest prefix within a limit never ends there. Null texts count as
empty: 0 bytes, 0 tokens. Strings of special tokens count as one token each, as is
the library's default. Rows are worked on alone, so repeated rows agree, skew
doesn't matter, empty tables give no rows, and other columns, whatever their names, aren't read. Long texts are cut at white space into parts of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import normalizers

from . import byte_bpe, common, scan

VOCABULARY = "word_bpe_49k.json"
CHUNK, REMEMBERED = 1_000_000, 500_000
#: Words of up to so many bytes are worked on together, so many bytes of them at a time; remembered pairs of tokens, and the size of their table.
TOGETHER, BATCH_BYTES, PAIRS, PAIR_BITS = 48, 100_000, 700_000, 20
#: The English contractions that are words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    return out | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


class _Trie:
    """The tokens by their bytes: which tokens, within words (``inner``) or ending them (``final``), lie along any text."""

    def __init__(self, tokens: list[str], end: str):
        letters = {c: b for b, c in _byte_letters().items()}
        moves: dict[int, int] = {}
        inner, final = [-1], [-1]
        for number, token in enumerate(tokens):
            bare, at = token.removesuffix(end), 0
            if not all(c in letters for c in bare):
                continue  # special tokens
            for c in bare:
                key = at << 8 | letters[c]
                if key not in moves:
                    moves[key] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                at = moves[key]
            (final if len(bare) < len(token) else inner)[at] = number
        self.keys = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[k] for k in self.keys.tolist()], np.int64)
        self.inner, self.final = np.array(inner, np.int32), np.array(final, np.int32)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have a move, and where it leads."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys.take(at) == key
        return there, self.to.take(at[there])


class WordTables:
    """Token counts of all prefixes of words."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.tokens = list(model["vocab"])
        self.vocabulary = frozenset(self.tokens)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.letters = _byte_letters()
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self._made: dict[str, tuple[str, str, float] | None] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._fits: dict[tuple[str, str], bool] = {}
        self._trie = _Trie(self.tokens, self.end)
        #: Whether a token's own text is encoded as it: 1 or 0, -1 if not yet known.
        self._whole = np.full(len(self.tokens), -1, np.int8)
        self._known_pairs = byte_bpe.Slots(PAIR_BITS)

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.end)
        out = list(bare)
        if len(bare) < len(token):
            out[-1] += self.end
        return out

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple | None]:
        """Plain pair merging, and the last pair that was merged with its rank."""
        last = None
        while len(symbols) > 1:
            k, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if k == 1 << 60:
                break
            last = (symbols[at], symbols[at + 1], k)
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols, last

    def made_of(self, token: str) -> tuple[str, str, float] | None:
        """The pair that makes the token and its rank; None if the token's own text isn't encoded as it."""
        if token not in self._made:
            symbols, last = self.merged(self._symbols(token))
            self._made[token] = None if len(symbols) > 1 else last or ("", "", -1)
        return self._made[token]

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at a token's left (0) or right (1) edge over time, each with the rank that ends it."""
        known = self._spines[side]
        if token not in known:
            out, until, at = [], float("inf"), token
            while at:
                out.append((at, until))
                made = self.made_of(at)
                until, at = made[2], made[side]
            known[token] = out
        return known[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens that stand side by side."""
        rank = self.rank.get
        for x, x_until in self._spine(left, 1):
            for y, y_until in self._spine(right, 0):
                k = rank((x, y))
                if k is not None and k < x_until and k <= y_until:
                    return False
        return True

    # -- one word, however long ------------------------------------------------------------

    def table(self, word: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... all code points of one piece."""
        if word in CONTRACTIONS:
            return [0, 1, *[1 + self.table(word[1:k])[-1] for k in range(2, len(word))], self._counts(word)[-1]]
        return self._counts(word)

    def _counts(self, word: str) -> list[int]:
        encoded = [c.encode() for c in word]
        letters = "".join(self.letters[b] for c in encoded for b in c)
        stops = np.cumsum([0, *map(len, encoded)]).tolist()
        last, count = self._open(letters)
        return [self._closed(letters, last, count, i) for i in stops]

    def _fit(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            self._fits[key] = self.fits(left, right)
        return self._fits[key]

    def _open(self, letters: str) -> tuple[list[str], list[int]]:
        """For each prefix, as the beginning of a longer word, its last token and its number of tokens."""
        size = len(letters)
        last, count = [""] * (size + 1), [0] * (size + 1)
        for i in range(1, size + 1):
            for j in range(max(0, i - self.longest), i):
                token = letters[j:i]
                if token in self.vocabulary and self.made_of(token) is not None and (not j or self._fit(last[j], token)):
                    last[i], count[i] = token, count[j] + 1
                    break
        return last, count

    def _closed(self, letters: str, last: list[str], count: list[int], i: int) -> int:
        """Tokens of the first i letters as a whole word: one that ends a word, after a beginning that it fits."""
        for j in range(max(0, i - self.longest), i):
            token = letters[j:i] + self.end
            if token in self.vocabulary and self.made_of(token) is not None and (not j or self._fit(last[j], token)):
                return count[j] + 1
        return 0

    # -- many words at once ----------------------------------------------------------------

    def tables(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all words, joined, and where each ends."""
        order, counts, sizes = [], [], []
        short = []
        for k, w in enumerate(words):
            if len(w) > TOGETHER or w[:1] == b"'":
                own = self.table(w.decode())
                order.append(np.array([k]))
                counts.append(np.array(own, np.int32))
                sizes.append(np.array([len(own)]))
            else:
                short.append(k)
        short.sort(key=lambda k: len(words[k]), reverse=True)
        begin = 0
        while begin < len(short):
            end, size = begin, 0
            while end < len(short) and (end == begin or size + len(words[short[end]]) <= BATCH_BYTES):
                size += len(words[short[end]])
                end += 1
            flat, each = self._together([words[k] for k in short[begin:end]])
            order.append(np.array(short[begin:end]))
            counts.append(flat)
            sizes.append(each)
            begin = end
        size, place = np.concatenate(sizes), np.argsort(np.concatenate(order))
        begins = (np.cumsum(size) - size)[place]
        return byte_bpe.gather(np.concatenate(counts), begins, size[place]), np.cumsum(size[place])

    def _usable(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens are the encoding of their own text."""
        for t in np.unique(tokens[self._whole.take(tokens) < 0]).tolist():
            self._whole[t] = self.made_of(self.tokens[t]) is not None
        return self._whole.take(tokens) == 1

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` of pairs of token numbers; a left of -1 is the beginning."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1)
        found = np.where(left < 0, 1, self._known_pairs.find(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            some, which = np.unique(keys[new], return_inverse=True)
            pairs = zip((some >> np.uint64(32)).tolist(), ((some & np.uint64(0xFFFFFFFF)) - np.uint64(1)).tolist(), strict=True)
            told = np.array([self.fits(self.tokens[a], self.tokens[b]) for a, b in pairs], np.int64)
            if self._known_pairs.used > PAIRS:
                self._known_pairs = byte_bpe.Slots(PAIR_BITS)
            self._known_pairs.add(some, told)
            found[new] = told[which]
        return found == 1

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of words, longest first, none long and none empty, joined, and their sizes."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes)
        begins = stops - sizes
        ends = np.repeat(stops, sizes)
        deep = min(self.longest, int(sizes[0]))
        # inner[l - 1, e], final[l - 1, e]: the token of l bytes whose last one is at e.
        inner, final = np.full((deep, len(data)), -1, np.int32), np.full((deep, len(data)), -1, np.int32)
        at, state = np.arange(len(data)), np.zeros(len(data), np.int64)
        for l in range(1, deep + 1):
            inside = at + l <= ends[at]
            at, state = at[inside], state[inside]
            there, state = self._trie.step(state, data[at + l - 1])
            at = at[there]
            for out, tokens in ((inner, self._trie.inner.take(state)), (final, self._trie.final.take(state))):
                some = np.flatnonzero(tokens >= 0)
                some = some[self._usable(tokens[some])]
                out[l - 1, at[some] + l - 1] = tokens[some]
        # Each word has a place for each of its prefixes, the empty one too.
        base = begins + np.arange(len(words))
        last, count, closed = np.full(len(data) + len(words), -1, np.int32), np.zeros(len(data) + len(words), np.int32), np.zeros(len(data) + len(words), np.int32)
        for i in range(1, int(sizes[0]) + 1):
            active = int(np.searchsorted(-sizes, -i, "right"))
            here, byte = base[:active] + i, begins[:active] + i - 1
            for table, of_words in ((inner, False), (final, True)):
                left = np.arange(active)
                for l in range(min(i, deep), 0, -1):
                    tokens = table[l - 1].take(byte[left])
                    some = np.flatnonzero(tokens >= 0)
                    if not len(some):
                        continue
                    before = here[left[some]] - l
                    good = self._fitting(last[before], tokens[some])
                    done, before = some[good], before[good]
                    to = here[left[done]]
                    if of_words:
                        closed[to] = count[before] + 1
                    else:
                        last[to], count[to] = tokens[done], count[before] + 1
                    rest = np.ones(len(left), bool)
                    rest[done] = False
                    left = left[rest]
                    if not len(left):
                        break
        # Prefixes in code points: those that no continuation byte follows.
        whole = np.ones(len(closed), bool)
        whole[np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes)] = (data & 0xC0) != 0x80
        return closed[whole], np.add.reduceat(whole, base, dtype=np.int64)


class _Stored:
    """The tables of words, numbered in the order of their first use."""

    def __init__(self, words: WordTables):
        self.words, self._new = words, []
        self._counts, self._used = np.zeros(1 << 16, np.int32), 0
        self._ends, self._known = np.zeros(1 << 12, np.int64), 0

    def learn(self, piece: bytes) -> None:
        self._new.append(piece)

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        """All tables joined, and where each ends; a 0 stands first."""
        if self._new:
            counts, ends = self.words.tables(self._new)
            self._counts, self._ends = (
                x if len(x) >= need else np.concatenate([x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)])
                for x, need in ((self._counts, self._used + len(counts)), (self._ends, self._known + len(ends) + 1))
            )
            self._counts[self._used : self._used + len(counts)] = counts
            self._ends[self._known + 1 : self._known + 1 + len(ends)] = ends + self._used
            self._used, self._known, self._new = self._used + len(counts), self._known + len(ends), []
        return self._counts[: self._used], self._ends[: self._known + 1]


@dataclass
class PrefixTable:
    """The counts of a text's prefixes of 0, 1, ... all code points; ``whole``: those that don't end inside a character."""

    counts: np.ndarray
    whole: np.ndarray

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, n: int) -> int:
        return int(self.counts[n])

    def longest(self, budget: int) -> int:
        """The most code points from the start, of whole characters, whose count is at most ``budget``."""
        return int(np.flatnonzero(self.whole & (self.counts <= budget))[-1])


class Counter:
    """Counts at all prefixes of whole texts."""

    def __init__(self, path: str | None = None):
        self.words = WordTables(path)
        self._forget()

    def _forget(self) -> None:
        self._stored = _Stored(self.words)
        self._index = byte_bpe.PieceIndex(self._stored.learn)

    def _plain(self, text: str) -> str:
        if text.isascii() or (max(text, default="") < "ɐ" and "İ" not in text):
            return text.lower()
        return self.words.normalise(text)

    def _normal(self, joined: str, ends: np.ndarray) -> np.ndarray:
        """Counts at the ends of all code points of normalised texts that are joined, as one running sum."""
        points = scan.code_points(joined)
        starts = scan.pieces_starts(points, ends, scan.words_only())
        raw = joined.encode("utf-8", "replace")
        at = starts if len(raw) == len(points) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts]
        solid = scan.class_table()[points[starts]] < scan.SPACE
        index = self._index.find(raw, at[solid], np.append(at[1:], len(raw))[solid])
        starts = starts[solid]
        counts, bounds = self._stored.get()
        begins, stops = bounds.take(index), bounds.take(index + 1)
        totals = counts.take(stops - 1).astype(np.int64)
        after = np.cumsum(totals)
        out = np.repeat(np.concatenate([[0], after]), np.diff(np.concatenate([[0], starts, [len(points)]])))
        # Within a piece: what stands before it and its own counts.
        own = byte_bpe.gather(counts, begins + 1, stops - begins - 1)
        size = stops - begins - 1
        out[byte_bpe.gather_places(starts, size)] = np.repeat(after - totals, size) + own
        return out

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text: special tokens (True), and between them parts of bounded size that begin with white space after something else."""
        parts: list[tuple[str, bool]] = [(text, False)]
        for s in self.words.special:
            if s in text:
                parts = [y for x, own in parts for y in ([(x, own)] if own else [z for p in x.split(s) for z in ((p, False), (s, True))][:-1])]
        for part, own in parts:
            begin = 0
            while not own and len(part) - begin > CHUNK:
                end = begin + CHUNK
                while end < len(part) and not (part[end] in " \n\t" and part[end - 1] not in " \n\t"):
                    end += 1
                yield part[begin:end], False
                begin = end
            if begin < len(part):
                yield part[begin:], own

    def _characters(self, text: str) -> list[int]:
        """Where the characters of a text end that are normalised by themselves."""
        normalise, stops, begin = self.words.normalise, [], 0
        for i in range(1, len(text)):
            # A mark behind white space composes with nothing, nor is it moved before it.
            if text[i] < "\u0300" or text[i - 1] in " \n\t" or (not unicodedata.combining(text[i]) and normalise(text[begin : i + 1]) == normalise(text[begin:i]) + normalise(text[i])):
                stops.append(i)
                begin = i
        return [*stops, len(text)] if text else stops

    def at_prefixes(self, text: str | None, exact: bool = True) -> np.ndarray:
        """The count of each prefix of 0, 1, ... all code points. Without ``exact``, prefixes that end inside a character are given as -1."""
        out, done, total = np.zeros(len(text or "") + 1, np.int64), 0, 0
        inside: list[int] = []
        for part, special in self._parts(text or ""):
            if special:
                inside += range(done + 1, done + len(part))
                out[done + len(part)] = total + 1
            else:
                plain = self._plain(part)
                counts = self._normal(plain, np.array([len(plain)])) + total
                if len(plain) == len(part) and unicodedata.is_normalized("NFC", part):
                    out[done + 1 : done + 1 + len(part)] = counts
                else:
                    stops = self._characters(part)
                    begin = at = 0
                    for stop in stops:
                        at += len(self.words.normalise(part[begin:stop]))
                        out[done + stop] = counts[at - 1]
                        inside += range(done + begin + 1, done + stop)
                        begin = stop
            done += len(part)
            total = int(out[done])
        out[inside] = -1
        for n in inside if exact else ():
            # Counted from a place whose left side doesn't matter: behind white space or a special token.
            begin = max([0, *[text.rfind(s, 0, n) + len(s) for s in self.words.special if s in text[:n]]])
            begin = max([begin, *[text.rfind(c, begin, n) + 1 for c in " \n\t"]])
            plain = self._plain(text[begin:n])
            out[n] = out[begin] + self._normal(plain, np.array([len(plain)]))[-1]
        return out

    def prefix_table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self.at_prefixes(text), self.at_prefixes(text, exact=False) >= 0)

    def each(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Row and counts at the prefixes (as ``at_prefixes`` without ``exact``) of every text that isn't empty."""
        if len(self._index) > REMEMBERED:
            self._forget()
        waiting: list[str] = []
        owners: list[int] = []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            if waiting:
                ends = np.cumsum([len(w) for w in waiting])
                counts = np.concatenate([[0], self._normal("".join(waiting), ends)])
                begins = np.concatenate([[0], ends[:-1]])
                for k, a, b in zip(owners, begins.tolist(), ends.tolist(), strict=True):
                    yield k, counts[a : b + 1] - counts[a]
            waiting.clear()
            owners.clear()

        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            plain = "" if len(text) > CHUNK or any(s in text for s in self.words.special) else self._plain(text)
            if len(plain) != len(text) or not (plain.isascii() or unicodedata.is_normalized("NFC", text)):
                yield k, self.at_prefixes(text, exact=False)
                continue
            if size + len(plain) > CHUNK:
                yield from flush()
                size = 0
            waiting.append(plain)
            owners.append(k)
            size += len(plain)
        yield from flush()

    def budgets(self, texts: list[str | None], budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Total tokens of each text, and its longest prefix (in code points, of whole characters) within the budget."""
        totals, fitting = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, counts in self.each(texts):
            totals[k] = counts[-1]
            fitting[k] = len(counts) - 1 if counts[-1] <= budget else np.flatnonzero((counts >= 0) & (counts <= budget))[-1]
        return totals, fitting


@cache
def counter(path: str | None = None) -> Counter:
    """One per worker process."""
    return Counter(path)


def count_tokens(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``chars_in_limit`` (longest prefix of whole characters within ``limit`` tokens)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            totals, fitting = count.budgets(texts, limit)
            sizes = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(totals), pa.array(totals > limit), pa.array(fitting)],
                names=[key, "n_bytes", "n_tokens", "over_limit", "chars_in_limit"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_in_limit bigint")


def prefix_tables(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``counts`` (array of int): the tokens of the prefixes of 0, 1, ... all code points, to be stored for later questions.

    Element n + 1 tells the tokens of the first n code points, the last one those of the text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            for begin, end in byte_bpe.groups(texts):
                found = [np.zeros(1, np.int64)] * (end - begin)
                for k, counts in count.each(texts[begin:end]):
                    found[k] = counts if (counts >= 0).all() else count.at_prefixes(texts[begin + k])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=[key, "counts"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, counts array<int>")
