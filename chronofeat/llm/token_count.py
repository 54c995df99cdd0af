"""Token counts that follow edits.

A text is cut into leaves at places where a pre-token surely begins: a single space between a
character that is no white space and a letter. No pre-token, and so no token, crosses such a
place, and the counts of leaves add up. A document keeps a segment tree over its leaves with sums
of characters and tokens. An edit finds its leaves by the character sums, re-encodes them alone,
takes in a neighbour where the edit spoilt the boundary to it, and updates the sums above.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed value: the pre-token pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies, and characters of a leaf, about.
RANKS, LEAF = "/opt/tokenizers/byte_bpe_50k.tiktoken", 512
CUT = regex.compile(r"(?<=\S) (?=\p{L})")


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def cut_leaves(text: str) -> list[str]:
    """The text in leaves of LEAF characters or more, as far as it has places to cut at; at least one."""
    out, at = [], 0
    while len(text) - at > LEAF and (m := CUT.search(text, at + LEAF)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def safe(left: str, right: str) -> bool:
    """Whether a pre-token surely ends between the two."""
    return not left or not right or CUT.search(left[-1] + right[:2]) is not None


class CountTree:
    """Leaves with sums of characters and tokens over them, in a heap-ordered binary tree."""

    def __init__(self, text: str, coder: tiktoken.Encoding):
        self.coder, self.recoded = coder, 0
        leaves = cut_leaves(text)
        self._grow(leaves, [len(coder.encode_ordinary(leaf)) for leaf in leaves])

    def _grow(self, leaves: list[str], tokens: list[int]) -> None:
        """The tree over these leaves, whose tokens are known: sums alone, nothing is encoded."""
        self.leaves, self.width = leaves, 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = ([0] * self.width + x + [0] * (self.width - len(leaves)) for x in ([len(leaf) for leaf in leaves], tokens))
        for v in range(self.width - 1, 0, -1):
            self._sum(v)

    def _sum(self, v: int) -> None:
        for x in (self.chars, self.tokens):
            x[v] = x[2 * v] + x[2 * v + 1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character place, and the place in it; the end belongs to the last leaf."""
        v = 1
        while v < self.width:
            v *= 2
            if place >= self.chars[v]:
                place -= self.chars[v]
                v += 1
        i = min(v - self.width, len(self.leaves) - 1)
        return i, place if i == v - self.width else len(self.leaves[i])

    def _put(self, i: int, leaf: str, counted: bool = True) -> None:
        self.leaves[i] = leaf
        v = self.width + i
        self.chars[v], self.tokens[v] = len(leaf), len(self.coder.encode_ordinary(leaf)) if counted else 0
        self.recoded += len(leaf) if counted else 0
        while v > 1:
            v //= 2
            self._sum(v)

    def edit(self, place: int, delete: int, insert: str) -> None:
        """Replace `delete` characters at `place` by `insert`; both are held to the text."""
        place = min(max(place, 0), self.chars[1])
        stop = min(place + max(delete, 0), self.chars[1])
        (i, s), (j, e) = self._leaf_at(place), self._leaf_at(stop)
        merged = self.leaves[i][:s] + insert + self.leaves[j][e:]
        # boundary context: neighbours whose border with the new text is no longer sure
        low, high = i, j
        while low and not safe(self._last(low), merged):
            low -= 1
            merged = self.leaves[low] + merged
        while high + 1 < len(self.leaves) and not safe(merged, self._next(high)):
            high += 1
            merged += self.leaves[high]
        # a long one is cut again; where that gives more leaves than it takes, the tree grows
        parts, room = cut_leaves(merged), high - low + 1
        if len(parts) <= room:
            for k in range(room):
                self._put(low + k, parts[k] if k < len(parts) else "", counted=k < len(parts))
            return
        self.recoded += len(merged)
        known = self.tokens[self.width : self.width + len(self.leaves)]
        known[low : high + 1] = [len(self.coder.encode_ordinary(x)) for x in parts]
        self._grow([*self.leaves[:low], *parts, *self.leaves[high + 1 :]], known)

    def _last(self, low: int) -> str:
        """What stands before leaf `low`, as far as it matters."""
        return next((self.leaves[k] for k in range(low - 1, -1, -1) if self.leaves[k]), "")

    def _next(self, high: int) -> str:
        return next((self.leaves[k] for k in range(high + 1, len(self.leaves)) if self.leaves[k]), "")


def count_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text", edits: str = "edits", ranks_path: str = RANKS) -> DataFrame:
    """Per row of docs (key, n_tokens_before, n_tokens, n_chars, n_recoded, n_leaves) after its edits, an array of (place, delete, insert).

    Edits are applied in their order, each to the text as it then stands, in characters; places
    beyond the text are held to it. Null texts and inserts are empty, null numbers 0; a null or
    empty array edits nothing. n_recoded counts the characters that edits made encode again.
    Repeated rows get equal results; an empty table an empty one. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(edits).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(held.value)
        for batch in batches:
            found = []
            for t, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = CountTree(t.as_py() or "", coder)
                before = tree.tokens[1]
                for place, delete, insert in ((x or {}).values() for x in changes.as_py() or []):
                    tree.edit(place or 0, delete or 0, insert or "")
                found.append((before, tree.tokens[1], tree.chars[1], tree.recoded, len(tree.leaves)))
            columns = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(list(x), pa.int64()) for x in columns)], ["key", "n_tokens_before", "n_tokens", "n_chars", "n_recoded", "n_leaves"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens_before long, n_tokens long, n_chars long, n_recoded long, n_leaves long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def with_edits(docs: DataFrame, edits: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """docs with its rows of an edit table (key, seq, place, delete, insert) as the array column `edits`, in the order of seq."""
    entry = F.struct("seq", "place", "delete", "insert")
    by_doc = edits.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("edits"))
    by_doc = by_doc.select(key, F.transform("edits", lambda x: F.struct(x["place"], x["delete"], x["insert"])).alias("edits"))
    return docs.join(by_doc, key, "left")
