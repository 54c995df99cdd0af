"""Piece ids of texts by vectorised merge rounds, equal to those of the sentencepiece library.

The library's model file gives pieces, scores and the normaliser. Between two characters that no
piece holds side by side nothing ever merges: there texts fall into words, and each different word
of a batch is encoded once. All words lie in one flat array of symbols. A round finds the best rank
of an adjacent pair in each word (a segmented minimum), merges its leftmost pair, and the array
closes up; words without a pair leave. Where no piece that a merge makes can join a neighbour at an
as good a rank, all pairs of that rank in the word merge at once, leftmost first: what the library
does one by one comes to the same.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import mix64, powers, small_batches

#: Where the model lies; characters that are encoded together, about; symbols of a word beyond which it takes a heap instead of rounds; ids of words that a process remembers.
MODEL, TOGETHER, LONG, KNOWN = "/opt/tokenizers/piece_bpe_32k.model", 1 << 18, 1024, 1 << 18
SPACE = "▁"
NONE = np.int32(1 << 30)
SLOTS = 1 << 21


class Pieces:
    """Merge tables of a model file.

    Symbols are the ids of pieces, then characters that only occur in longer pieces, then, from
    `unknown` on, all other characters by their code point.
    """

    def __init__(self, model: bytes):
        self.library = sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a model with unused pieces is not supported")
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        self.n, self.bytes = n, np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if sp.unk_id() in self.bytes:
            raise ValueError("a model without byte pieces is not supported")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols) - len(pieces))
        self.unknown = n + len(symbols) - len(pieces)
        self.only_inside = {i: ord(c) for c, i in symbols.items() if i >= n}
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.unknown)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.beside = np.zeros(SLOTS, bool)  # pairs of characters inside pieces, by a hash: an extra one only leaves a word uncut
        inside = np.array([(symbols[a], symbols[b]) for p in pieces for a, b in zip(p, p[1:], strict=False)]).reshape(-1, 2)
        self.beside[self._slot(inside[:, 0], inside[:, 1])] = True
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # several pieces of one score, or a longer piece that holds the merged one at either end and ranks no worse, ask for one merge at a time
        shared = [0] * len(ranks)
        for s in scores.values():
            shared[ranks[s]] += 1
        self.at_once = np.array([x == 1 for x in shared] + [False])
        for p, s in scores.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and scores.get(part, s + 1) <= s:
                        self.at_once[ranks[scores[part]]] = False
        pairs = [(symbols[p[:k]], symbols[p[k:]], ranks[s], pieces[p]) for p, s in scores.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        left, right, rank, made = np.array(pairs, np.int64).reshape(-1, 4).T
        keys = left << 32 | right
        order = np.argsort(keys)
        self.rank, self.made = rank[order].astype(np.int32), made[order].astype(np.int32)
        self.keys = keys[order]
        self.slots = self._place(self.keys)
        # words of earlier batches by their hashes, and where their ids lie; the first is none
        self.seen, self.seen_counts, self.seen_begin, self.seen_ids = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        """Open addressing: number of the key in each slot, -1 in empty ones."""
        slots, todo = np.full(SLOTS, -1, np.int32), np.arange(len(keys))
        at = (mix64(keys.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = slots[at] < 0
            slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (SLOTS - 1)
        return slots

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of adjacent symbols; NONE where they make no piece."""
        keys = left.astype(np.int64) << 32 | right
        rank, made = np.full(len(keys), NONE), np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        at = (mix64(keys.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            held = self.slots[at]
            full = held >= 0
            todo, at, held = todo[full], at[full], held[full]
            hit = self.keys[held] == keys[todo]
            rank[todo[hit]], made[todo[hit]] = self.rank[held[hit]], self.made[held[hit]]
            todo, at = todo[~hit], (at[~hit] + 1) & (SLOTS - 1)
        return rank, made

    # ------------------------------------------------------------ words

    def words(self, symbols: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Starts of words in a flat array of characters' symbols, none across edges."""
        cut = np.ones(len(symbols), bool)
        known = symbols < self.unknown
        cut[1:] = ~(known[1:] & known[:-1] & self.beside[self._slot(symbols[:-1], symbols[1:])])
        cut[edges[edges < len(symbols)]] = True
        return np.flatnonzero(cut)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words given by their starts after all merges: (symbols, number of symbols of each word)."""
        sizes = np.diff(starts, append=len(symbols))
        done: dict[int, np.ndarray] = {}
        counts = np.zeros(len(starts), np.int64)
        for w in np.flatnonzero(sizes > LONG).tolist():
            done[w] = self.merge_long(symbols[starts[w] : starts[w] + sizes[w]])
        finished: list[tuple[np.ndarray, np.ndarray]] = [(np.full(len(x), w), x) for w, x in done.items()]
        words = np.flatnonzero(sizes <= LONG)
        keep = np.repeat(sizes <= LONG, sizes)
        sym, word = symbols[keep].astype(np.int32), np.repeat(words, sizes[words])
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.look_up(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(first, append=len(sym))
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, size)
                finished.append((word[gone], sym[gone]))
                stay = ~gone
                sym, word, rank, made, size, best = sym[stay], word[stay], rank[stay], made[stay], size[~over], best[~over]
                if not len(sym):
                    break
            per_symbol = np.repeat(best, size)
            at = np.flatnonzero(rank == per_symbol)
            apart = np.concatenate([[True], at[1:] != at[:-1] + 1])  # runs of overlapping pairs take every other one
            run = np.flatnonzero(apart)
            turn = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            leads = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            at = at[leads | (self.at_once[per_symbol[at]] & (turn % 2 == 0))]
            sym[at] = made[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            moved = np.cumsum(left) - 1
            at = moved[at]
            sym, word, rank, made = sym[left], word[left], rank[left], made[left]
            rank[at] = NONE  # the pair is gone; what is now beside it on either side is looked up
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            fresh = np.flatnonzero(near[:-1] & (word[1:] == word[:-1]))
            rank[fresh], made[fresh] = self.look_up(sym[fresh], sym[fresh + 1])
        if not finished:
            return np.zeros(0, np.int32), counts
        word, sym = (np.concatenate([x[k] for x in finished]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        counts += np.bincount(word, minlength=len(starts))
        return sym[order], counts

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word through a heap of pairs by rank and place, as a round for each merge would cost its length."""
        sym, n = symbols.astype(np.int32).tolist(), len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []
        rank, made = (x.tolist() for x in self.look_up(symbols[:-1], symbols[1:]))
        heap = [(rank[i], i, sym[i], sym[i + 1], made[i]) for i in range(n - 1) if rank[i] != NONE]
        heapq.heapify(heap)
        table = self.plain

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (hit := table.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            if sym[i] != a or (j := after[i]) < 0 or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = piece, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([s for s in sym if s >= 0], np.int32)

    @property
    def plain(self) -> dict[int, tuple[int, int]]:
        """The merge table as a dict."""
        if not hasattr(self, "_plain"):
            self._plain = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        return self._plain

    def spelt(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, counts
        spelt = [self.bytes[np.frombuffer(chr(self.only_inside.get(s, s - self.unknown)).encode(), np.uint8)] for s in symbols[odd].tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(x) for x in spelt]
        ends = np.cumsum(sizes)
        out = np.repeat(symbols, sizes)
        for i, x in zip(odd.tolist(), spelt, strict=True):
            out[ends[i] - len(x) : ends[i]] = x
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, weights=sizes, minlength=len(counts)).astype(np.int64)

    # ------------------------------------------------------------ texts

    def ids(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts, without begin and end."""
        lengths = [len(x) for x in parts]
        edges = np.cumsum([0, *lengths])
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        if not len(chars):
            return [np.zeros(0, np.int32) for _ in parts]
        symbols = self.of_char[chars]
        starts = self.words(symbols, edges)
        ends = np.append(starts[1:], len(symbols))
        up, down = powers(len(symbols) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(symbols.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.seen, different), len(self.seen) - 1)
        new = self.seen[at] != different
        own, own_starts = ragged(symbols, starts[first[new]], ends[first[new]] - starts[first[new]])
        merged, added = self.spelt(*self.merge(own, own_starts))
        counts, begin = self.seen_counts[at], self.seen_begin[at]
        counts[new], begin[new] = added, np.cumsum(added) - added + len(self.seen_ids)
        merged = np.concatenate([self.seen_ids, merged])
        if len(merged) <= KNOWN:
            order = np.argsort(both := np.concatenate([self.seen, different[new]]))
            self.seen, self.seen_ids = both[order], merged
            self.seen_counts, self.seen_begin = (np.concatenate(x)[order] for x in ((self.seen_counts, counts[new]), (self.seen_begin, begin[new])))
        out, out_starts = ragged(merged, begin[which], counts[which])
        bounds = np.append(out_starts, len(out))[np.searchsorted(starts, edges)]
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with begin and end, as the library's encode() gives them."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            for part in self.cut(self.library.normalize(text)):
                parts.append(part)
                owner.append(k)
        found: list[list[np.ndarray]] = [[] for _ in texts]
        a = 0
        while a < len(parts):
            b, size = a + 1, len(parts[a])
            while b < len(parts) and size + len(parts[b]) <= TOGETHER:
                size += len(parts[b])
                b += 1
            for k, x in zip(owner[a:b], self.ids(parts[a:b]), strict=True):
                found[k].append(x)
            a = b
        begin, end = ([i] for i in (self.library.bos_id(), self.library.eos_id()))
        return [np.concatenate([begin, *x, end]).astype("<u4") for x in found]

    def cut(self, text: str) -> list[str]:
        """A long text in parts between words; at least one."""
        out, at = [], 0
        while self.cuts_at_space and len(text) - at > TOGETHER and (m := BETWEEN.search(text, at + TOGETHER - 1)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]


BETWEEN = re.compile(rf"(?<=[^{SPACE}]){SPACE}")


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after the other, and where each then starts."""
    out = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - out, sizes) + np.arange(int(sizes.sum()))], out


@lru_cache(maxsize=1)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def encoded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """Per row of docs (key, ids array<int>, decoded): the ids with begin and end, and what the library decodes from them."""
    return _run(docs, key, text, model_path, "ids array<int>, decoded string", lambda ids, back: (pa.array(list(ids), pa.list_(pa.int32())), pa.array(back, pa.string())))


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """Per row of docs (key, n_tokens, ids_sha256, decoded_sha256).

    Ids have begin and end; their digest is over little-endian unsigned 32-bit numbers, the other
    over the UTF-8 of what the library decodes from them. A null or empty text has the two ids
    alone and decodes to an empty one. Equal texts give equal rows, repeated rows too; an empty
    table an empty one. Other columns are not looked at. Texts are taken whole: long ones are
    encoded by parts between words, and take some 40 bytes a token when they are decoded. Equal
    words are told by 64-bit hashes; a word of more than 1,024 symbols takes a heap instead of rounds.
    """

    def columns(ids: list[np.ndarray], back: list[str]) -> tuple[pa.Array, ...]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids]), pa.array([sha(x.encode()) for x in back])

    return _run(docs, key, text, model_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs: DataFrame, key: str, text: str, model_path: str, out: str, columns) -> DataFrame:
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(held.value)
        names = ["key", *(c.split()[0] for c in out.split(", "))]
        for batch in batches:
            a = 0
            while a < batch.num_rows:  # some texts at a time, a long one alone
                texts, size = [], 0
                while a + len(texts) < batch.num_rows and (not texts or size < TOGETHER):
                    texts.append(batch.column("text")[a + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids = coder.encode(texts)
                back = [coder.library.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, len(texts)), *columns(ids, back)], names)
                a += len(texts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {out}").withColumnRenamed("key", key)
