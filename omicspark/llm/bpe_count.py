"""Token counts by heap-and-linked-list byte-pair merging, without making token ids."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers; beyond this the memory starts anew.
MEMO_WORDS = 1 << 20
#: The white space and the word pattern of byte-level files that name none of their own.
_SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pattern(text: str) -> regex.Pattern:
    """A pattern of the file, where \\s means Unicode white space without the four information separators."""
    return regex.compile(text.replace(r"[^\s", "[^" + _SPACE[1:-1]).replace(r"\s", _SPACE).replace(r"\S", "[^" + _SPACE[1:]))


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class BpeCounter:
    """Counts tokens as the vocabulary file's own library does, special strings included."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        suffix = model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.steps = [self._step(n) for n in self._parts(spec.get("normalizer"), "normalizers")]
        self.words = self._words(self._parts(spec.get("pre_tokenizer"), "pretokenizers"))
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only added tokens that are matched as they stand are supported")
        longest = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(regex.escape(t) for t in longest)) if longest else None
        self.memo: dict[str, int] = {}

    @staticmethod
    def _parts(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    @staticmethod
    def _step(part: dict):
        if part["type"] == "NFC":
            return lambda t: t if t.isascii() else unicodedata.normalize("NFC", t)
        if part["type"] == "Lowercase":
            return lambda t: t.replace("\u03a3", "\u03c3").lower()  # each character for itself, also a final sigma
        if part["type"] == "Replace" and "Regex" in part["pattern"]:
            find = _pattern(part["pattern"]["Regex"])
            return lambda t: find.sub(lambda _: part["content"], t)
        raise ValueError(f"unknown normalizer {part['type']}")

    @staticmethod
    def _words(parts: list[dict]) -> regex.Pattern:
        if len(parts) == 2 and parts[0]["type"] == "Split" and not parts[1]["use_regex"]:
            if parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
                return _pattern(parts[0]["pattern"]["Regex"])
        if len(parts) == 1 and parts[0]["type"] == "ByteLevel" and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            return _pattern(_BYTE_LEVEL)
        raise ValueError("unknown pre-tokenizer")

    def count_word(self, word: str) -> int:
        """Initial symbols minus merges.

        The symbols form a linked list and adjacent pairs that can merge wait in a heap by rank, then place.
        A popped pair counts only if both symbols still stand there unchanged.
        """
        data = word.encode("utf-8", "replace")
        ids: list[int | None] = [self.inner[b] for b in data]
        size = len(ids)
        ids[-1] = self.final[data[-1]]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = self.merges
        heap = []
        for i in range(size - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= size or merges.get((ids[i], ids[j])) != (rank, made):
                continue
            done += 1
            ids[i], ids[j] = made, None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return size - done

    def _count_plain(self, text: str) -> int:
        for step in self.steps:
            text = step(text)
        total, memo = 0, self.memo
        for word in self.words.findall(text):
            n = memo.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of one text; null counts as empty. A special string is one token."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._count_plain(p) for p in parts if p)


@functools.lru_cache(maxsize=2)
def _counter(content: bytes) -> BpeCounter:
    return BpeCounter(content)


def token_count(text: Column | str, vocabulary: str) -> Column:
    """Number of tokens of a text column under the vocabulary file at the path ``vocabulary``.

    The file, of a few MB, is read on the driver and travels with the function, so executors need no copy.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()

    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(content)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return apply(text)


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row.

    Whole texts are counted; null and empty texts have zero bytes and tokens. Equal rows, and null ids, each
    keep their row. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    counted = own.select("id", F.octet_length("body").cast("long").alias("n_bytes"), token_count("body", vocabulary).alias("n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
