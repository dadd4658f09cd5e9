"""Byte-level BPE by speculation and verification.

For the distinct words of a piece of text, the longest vocabulary entry at every byte is looked up for all words at once, and
walking from entry to entry proposes a word's tokens. A proposal is the BPE encoding exactly if every
adjacent pair of its tokens encodes to itself, so all pairs of all words are checked against a table of pairs known to be compatible or not;
pairs not met before are decided by exact merging of their bytes. Only words with a failing pair are merged exactly, short ones all at once,
a merge of each a round.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_batches, pieces, ragged

#: The word pattern of byte-level BPE vocabularies (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, their characters, and pairs that a task remembers; beyond, it starts afresh, and so it does after a batch with a word of over LONG characters.
WORDS, CHARACTERS, PAIRS, LONG = 225_000, 1 << 23, 300_000, 1 << 12
#: Words of up to so many bytes are merged together, so many at a time; NEVER is the rank of a pair that does not merge.
SHORT, TOGETHER, NEVER = 48, 2048, 2**31 - 1
#: Bits of a hash that tell most places without a vocabulary entry.
FIRST = 18


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE read from a tokenizers JSON file. Its added tokens are matched in the text first, longest first where two start together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.token = {i: as_bytes(s) for s, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.token.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.id_of[a], self.id_of[b]] = rank, self.id_of[a + b]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token |= {i: s.encode() for s, i in self.added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(PATTERN).findall
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self._index()
        self._index_merges()
        n = max(self.token) + 1
        self.token_size = np.array([len(self.token.get(i, b"")) for i in range(n)], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(n)), np.uint8)
        self.pairs: dict[int, bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        """Forget all words but the added tokens. place: a word's number; store: by number, where its tokens start in known, and how many they are."""
        self.place: dict[str, int] = {s: i for i, s in enumerate(self.added)}
        self.known = np.array([*self.added.values()], np.int32)
        self.store = np.stack([np.arange(len(self.known)), np.ones(len(self.known), np.int64)], axis=1)
        self.held = 0

    def _index(self) -> None:
        """Vocabulary entries by length, each length's polynomial hashes sorted, and which first FIRST bits they have."""
        self.mul = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.value = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        by_size: dict[int, list[bytes]] = {}
        for b in self.id_of:
            by_size.setdefault(len(b), []).append(b)
        self.by_size = {}
        for size, group in sorted(by_size.items()):
            codes = np.zeros(len(group), np.uint64)
            for column in np.frombuffer(b"".join(group), np.uint8).reshape(len(group), size).T:
                codes = codes * self.mul + self.value[column]
            order = np.argsort(codes)
            if len(np.unique(codes)) < len(codes):
                raise ValueError("two vocabulary entries share a hash")
            had = np.zeros(1 << FIRST, bool)
            had[codes >> np.uint64(64 - FIRST)] = True
            self.by_size[size] = codes[order], np.array([self.id_of[group[i]] for i in order], np.int64), had

    def _index_merges(self) -> None:
        """Ranks of the pairs that merge: of pairs of bytes in a table, of all sorted by pair; and what each rank makes."""
        codes = np.array([a << 20 | b for a, b in self.merges] + [2**62], np.int64)
        ranks, made = np.array([*self.merges.values(), (NEVER, 0)], np.int64).T
        order = np.argsort(codes)
        self.merge_codes, self.merge_ranks = codes[order], ranks[order].astype(np.int32)
        self.made = np.zeros(max(ranks[:-1], default=0) + 1, np.int32)
        self.made[ranks[:-1]] = made[:-1]
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self.rank(self.single[a], self.single[b])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NEVER where it has none; -1 is no token."""
        codes = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.merge_codes, codes)
        at[codes < 0] = len(self.merge_codes) - 1
        return np.where(self.merge_codes[at] == codes, self.merge_ranks[at], np.int32(NEVER))

    def exact_short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of tokens of each word, filled up with -1: as ``exact``, with a merge of every word in each round."""
        width = int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        byte = np.where(inside, data[np.minimum(starts[:, None] + column, len(data) - 1)], 0).astype(np.int64)
        ids = np.where(inside, self.single[byte], -1).astype(np.int32)
        ranks = np.where(inside[:, 1:], self.byte_ranks[byte[:, :-1] << 8 | byte[:, 1:]], np.int32(NEVER))
        out, row = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
        while width > 1:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(at)), at]
            if (low == NEVER).any():
                ended, on = low == NEVER, low != NEVER
                out[row[ended], :width] = ids[ended]
                ids, ranks, at, low, row = ids[on], ranks[on], at[on], low[on], row[on]
            if not len(row):
                return out
            width -= 1
            k, new = np.arange(len(row)), self.made[low]
            shift = column[:width] + (column[:width] > at[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[k, at] = new
            ranks = np.take_along_axis(ranks, shift[:, : width - 1], axis=1)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], new[some])
            some = np.flatnonzero(at + 1 < width)
            ranks[some, at[some]] = self.rank(new[some], ids[some, at[some] + 1])
        out[row, :width] = ids
        return out

    def exact_many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``exact`` of many words of these bytes: all tokens one word after the other, and each word's count."""
        order = np.argsort(sizes, kind="stable")
        short = order[: int(np.searchsorted(sizes[order], SHORT, "right"))]
        runs, counts = [np.zeros(0, np.int32)], np.zeros(len(sizes), np.int64)
        for some in (short[k : k + TOGETHER] for k in range(0, len(short), TOGETHER)):
            got = self.exact_short(data, starts[some], sizes[some])
            counts[some] = (got >= 0).sum(axis=1)
            runs.append(got[got >= 0])
        for k in order[len(short) :].tolist():
            runs.append(np.array(self.exact(data[starts[k] : starts[k] + sizes[k]].tobytes()), np.int32))
            counts[k] = len(runs[-1])
        first = np.cumsum(counts[order]) - counts[order]
        place = np.empty(len(order), np.int64)
        place[order] = first
        return np.concatenate(runs)[ragged(place, counts)], counts

    def exact(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := rank((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := rank((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := rank((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [x for x in ids if x >= 0]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of each pair of tokens encode to that pair."""
        codes, where = np.unique(left << 20 | right, return_inverse=True)
        known = self.pairs
        if len(known) > PAIRS:
            known.clear()
        out = np.empty(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            ok = known.get(code)
            if ok is None:
                a, b = code >> 20, code & 0xFFFFF
                ok = known[code] = self.exact(self.token[a] + self.token[b]) == [a, b]
            out[k] = ok
        return out[where]

    def longest(self, data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest entry at every byte of the words; left: bytes from there to the word's end."""
        best = self.single[data]
        at, codes = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for size in range(1, max(self.by_size) + 1):
            inside = left[at] >= size
            at, codes = at[inside], codes[inside]
            if not len(at):
                break
            codes = codes * self.mul + self.value[data[at + size - 1]]
            if size > 1 and size in self.by_size:
                table, ids, had = self.by_size[size]
                may = np.flatnonzero(had[codes >> np.uint64(64 - FIRST)])
                k = np.minimum(np.searchsorted(table, codes[may]), len(table) - 1)
                hit = table[k] == codes[may]
                best[at[may[hit]]] = ids[k[hit]]
        return best

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words one after the other, and each word's count."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        encoded = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        best = self.longest(data, np.repeat(ends, sizes) - np.arange(len(data)))
        step = self.token_size[best]
        proposed, owner = [], []
        at, who = ends - sizes, np.arange(len(words))
        while len(at):
            proposed.append(best[at])
            owner.append(who)
            at = at + step[at]
            more = at < ends[who]
            at, who = at[more], who[more]
        ids, who = np.concatenate(proposed), np.concatenate(owner)
        order = np.argsort(who, kind="stable")
        ids, who = ids[order], who[order]
        counts = np.bincount(who, minlength=len(words))
        same = who[1:] == who[:-1]
        bad = np.zeros(len(words), bool)
        bad[who[1:][same][~self.compatible(ids[:-1][same], ids[1:][same])]] = True
        alone = np.flatnonzero(counts == 1)
        first = np.cumsum(counts) - counts
        for t in np.unique(ids[first[alone]]).tolist():
            key = -1 - t
            if key not in self.pairs:
                self.pairs[key] = self.exact(self.token[t]) == [t]
        bad[alone] |= ~np.array([self.pairs[-1 - t] for t in ids[first[alone]].tolist()], bool)
        merged, of_bad = self.exact_many(data, (ends - sizes)[bad], sizes[bad])
        good = ids[~bad[who]]
        of_good, counts[bad] = counts[~bad], of_bad
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[ragged(first[~bad], of_good)] = good
        out[ragged(first[bad], of_bad)] = merged
        return out, counts

    def split(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self.words(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts one after the other, and each text's count."""
        if len(self.store) > WORDS or self.held > CHARACTERS:
            self._fresh()
        lists = [self.split(t) for t in texts]
        flat = [w for x in lists for w in x]
        place = self.place
        new = [w for w in dict.fromkeys(flat) if w not in place]
        place.update(zip(new, range(len(self.store), len(self.store) + len(new)), strict=True))
        tokens, sizes = self.encode_words(new)
        self.store = np.concatenate([self.store, np.stack([len(self.known) + np.cumsum(sizes) - sizes, sizes], axis=1)])
        self.known = np.concatenate([self.known, tokens])
        sizes = [len(w) for w in new]
        self.held += sum(sizes) if max(sizes, default=0) <= LONG else CHARACTERS + 1
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        starts, per_word = self.store[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))].T
        ids = self.known[ragged(starts, per_word)]
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of tokens; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        ids = ids.astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, -1)
        sizes = np.where(ids >= 0, self.token_size[ids], 0)
        data = self.token_bytes[ragged(self.token_start[ids], sizes)].tobytes()
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        bounds = zip(total[ends - counts].tolist(), total[ends].tolist(), strict=True)
        return [data[a:b].decode("utf-8", "replace") for a, b in bounds]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per task process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Add ids (array of int) and, with decode, decoded: the text that those ids give back.

    path: a tokenizers JSON file that every executor has. A null text has no tokens and decodes to an empty
    string. Rows are encoded one by one, so repeated rows and ids give repeated results; columns named ids or decoded are replaced. Texts of any length are
    taken whole; a word without any break is merged in n log n steps.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for piece in pieces(batches, text):
            texts = [x or "" for x in piece.column(text).to_pylist()]
            ids, counts = t.encode_batch(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [piece.column(c) for c in names] + [pa.ListArray.from_arrays(offsets, ids)]
            if decode:
                columns.append(pa.array(t.decode_batch(ids, counts), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "decoded"][: len(columns)])

    return map_batches(docs, run, schema)
