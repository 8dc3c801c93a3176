"""SentencePiece models run by the tokenizers library: encoding, decoding and a check of parity."""

from __future__ import annotations

import functools
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse
from operator import eq

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

#: Fixed values of the model format: piece types, model types, the marker of a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Texts and characters that are encoded together, and threads that encode them.
BATCH_TEXTS, PART_CHARS, THREADS = 256, 1 << 20, 2
#: Words whose ids a worker remembers; beyond this the memory starts anew.
KNOWN_WORDS = 1 << 19
#: New words that are encoded as one text.
WORDS_TOGETHER = 64
_TWO_MARKS = MARK * 2
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_SPACES = re.compile(" {2,}")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; nested messages and floats stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("the message is cut off")
            value = data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces (text, score, type) in id order and how texts are prepared."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return cls(
            tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown, norm.get(2, b""),
            bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)),
        )


def _normalizer(model: Model):
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if model.escape_spaces else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first: the order in which pairs join."""
    ids = {p[0]: i for i, p in enumerate(model.pieces) if p[2] == NORMAL}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-score, i, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def keeps_words_apart(model: Model) -> bool:
    """True where no piece holds the space marker after another character, so no token crosses into the next word."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL)


def rebuild(model: Model) -> Tokenizer:
    """A tokenizers pipeline that gives the ids of the model."""
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=unknown, fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = _normalizer(model)
    if keeps_words_apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD.pattern), "isolated")
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


def _spelling(piece: str, kind: int) -> bytes | None:
    """The bytes a piece stands for; None for the unknown piece and controls."""
    if kind == BYTE:
        return bytes([int(piece[3:-1], 16)])
    return piece.encode() if kind == NORMAL else None


class Codec:
    """Encodes and decodes batches by the rebuilt pipeline, with the model's own library for parity.

    Where words stay apart, the ids of a text are those of its words one after the other. The words of a batch
    that are not yet known go through the pipeline and the model's library together, on several threads, and are
    remembered.
    """

    def __init__(self, content: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.parse(content)
        self.tokenizer = rebuild(self.model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.threads = threads
        self.apart = keeps_words_apart(self.model)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.lead = MARK if self.model.dummy_prefix and self.model.escape_spaces else ""
        self.spelling = [_spelling(p, kind) for p, _, kind in self.model.pieces]
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.known: dict[str, bytes] = {}
        self.altered: dict[str, str] = {}
        self.unlike: set[str] = set()
        # Parity of a text is that of its normal form and of each of its words, where the library can be given a
        # word as it stands in a text; else the text itself is encoded by both.
        self.checks_words = self.apart and self.model.escape_spaces and (self.model.dummy_prefix or not self.model.squeeze_spaces)

    def normalise(self, text: str) -> str:
        """The text as the pieces see it: the same steps as the pipeline's normalizer, without its bookkeeping."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze_spaces:
            text = _SPACES.sub(" ", text.strip(" "))
        if self.model.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape_spaces else text

    def keys(self, plain: str) -> list[str]:
        """The words of a normal form. Where each begins with a marker, their keys go without that one."""
        if not self.lead:
            return _WORD.findall(plain)
        if _TWO_MARKS in plain or plain[-1:] == MARK:
            return [w[1:] for w in _WORD.findall(plain)]
        return plain[1:].split(MARK) if plain else []

    def learn(self, keys: set[str]) -> None:
        """Ids of words; the decoded text of those that decoding does not give back; those without parity.

        Words go through the pipeline, and through the model's library, as one text for many of them: no token
        crosses into the next word, and a word begins where a piece begins with the marker. A group that does
        not come out alike on all counts is gone through word by word.
        """
        joined = [k for k in keys if k and MARK not in k] if self.lead and self.checks_words else []
        groups = [joined[at : at + WORDS_TOGETHER] for at in range(0, len(joined), WORDS_TOGETHER)]
        bodies = [self.lead + self.lead.join(g) for g in groups]
        found = [e.ids for e in self.words.encode_batch_fast(bodies, add_special_tokens=False)]
        own = self.reference([b[1:].replace(MARK, " ") for b in bodies])
        alone = set(keys).difference(joined)
        for group, body, ids, theirs in zip(groups, bodies, found, own):
            packed = array("i", ids)
            starts = np.flatnonzero(self.opens[np.frombuffer(packed, dtype=np.int32)])
            if ids != theirs or len(starts) != len(group) or not self.spells(ids, body):
                alone.update(group)
                continue
            data, cuts = packed.tobytes(), (starts * 4).tolist()
            self.known.update(zip(group, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
        self.learn_alone(list(alone))

    def spells(self, ids: list[int], text: str) -> bool:
        """Whether the bytes of the pieces, one after the other, are those of the text, which decoding then gives."""
        try:
            return b"".join(map(self.spelling.__getitem__, ids)) == text.encode("utf-8", "replace")
        except TypeError:  # an unknown piece
            return False

    def learn_alone(self, new: list[str]) -> None:
        """What ``learn`` does, each word by itself."""
        words = [self.lead + k for k in new]
        ids = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        self.known.update(zip(new, map(_packed, ids)))
        other = [i for i, (word, found) in enumerate(zip(words, ids)) if not self.spells(found, word)]
        for i, text in zip(other, self.words.decode_batch([ids[i] for i in other], skip_special_tokens=False)):
            if text != words[i].replace(MARK, " "):
                self.altered[new[i]] = text
        if self.checks_words:
            # The model's library sets the first marker itself, but not for an empty text.
            bare = [k.replace(MARK, " ") for k in new]
            own = [x if t else [self.own.piece_to_id(MARK)] for t, x in zip(bare, self.reference(bare))]
            self.unlike.update(k for k, a, b in zip(new, ids, own) if a != b)

    def round(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """(ids as int32 bytes, decoded text, parity with the model's own library) of each text."""
        if not self.apart:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return list(zip(map(_packed, ids), self.decode(ids), map(eq, ids, self.reference(texts))))
        plain = [self.normalise(t) for t in texts]
        cut = [self.keys(t) for t in plain]
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(cut)))
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, self.altered, self.unlike, new = {}, {}, set(), set().union(*cut)
        self.learn(new)
        made = [b"".join(map(self.known.__getitem__, keys)) for keys in cut]
        if self.checks_words:
            parity = [self.own.normalize(t) == p and self.unlike.isdisjoint(k) for t, p, k in zip(texts, plain, cut)]
        else:
            parity = [ids == _packed(own) for ids, own in zip(made, self.reference(texts))]
        decoded = []
        for text, keys in zip(plain, cut):
            if self.altered and not self.altered.keys().isdisjoint(keys):
                text = "".join([self.altered.get(k, self.lead + k) for k in keys])
            text = text.replace(MARK, " ")
            decoded.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        for key in new:
            if len(key) > 64:
                self.altered.pop(key, None)
                self.unlike.discard(key)
                del self.known[key]
        return list(zip(made, decoded, parity))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, dtype=np.int32).tolist() for ids, _, _ in self.round(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def reference(self, texts: list[str]) -> list[list[int]]:
        """Ids from the model's own library."""
        return self.own.encode(texts, num_threads=self.threads)


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@functools.lru_cache(maxsize=2)
def _codec(content: bytes, threads: int) -> Codec:
    return Codec(content, threads)


def _parts(column: pd.Series) -> Iterator[list[str]]:
    """The texts of a batch in parts of at most BATCH_TEXTS texts and, but for a single longer text, PART_CHARS characters."""
    part, size = [], 0
    for text in column:
        text = text or ""
        if part and (len(part) == BATCH_TEXTS or size + len(text) > PART_CHARS):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part or not len(column):
        yield part


def _content(model: str) -> bytes:
    with open(model, "rb") as file:
        return file.read()


_ENCODED = "ids array<int>, decoded string, parity boolean"


def encoded(text: Column | str, model: str, threads: int = THREADS) -> Column:
    """Struct (ids, decoded, parity) of a text column under the model file at the path ``model``.

    ``ids`` are those of the tokenizers pipeline; ``parity`` says whether the model's own library gives the
    same (see ``Codec``); ``decoded`` is the text of the ids. The file, under a MB, is read on the driver and travels along.
    """
    content = _content(model)

    @F.pandas_udf(_ENCODED)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(content, threads)
        for column in batches:
            for texts in _parts(column):
                made = codec.round(texts)
                # A few bytes an id, and no more than one part's ids at a time, whatever Arrow's batches hold.
                ids = pd.Series([np.frombuffer(x, dtype=np.int32) for x, _, _ in made], dtype=object)
                yield pd.DataFrame({"ids": ids, "decoded": [x[1] for x in made], "parity": [x[2] for x in made]})

    return apply(text)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """(id, ids, n_tokens, parity, round_trip), one row per input row.

    ``round_trip`` says whether decoding gives the text again, which a text with the marker U+2581 itself, or a
    model that changes texts before encoding, does not. Null and empty texts have no ids. Whole texts of any
    length are encoded; equal rows and null ids each keep their row. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    both = own.withColumn("made", encoded("body", model, threads))
    return both.select(
        F.col("id").alias(id_col),
        F.col("made.ids").alias("ids"),
        F.size("made.ids").alias("n_tokens"),
        F.col("made.parity").alias("parity"),
        (F.col("made.decoded") == F.col("body")).alias("round_trip"),
    )


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "text", threads: int = THREADS) -> DataFrame:
    """``rows`` with the text of each id list in ``out``; a null list gives null, an empty one the empty text."""
    content = _content(model)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(content, threads)
        for column in batches:
            lists = [None if x is None else [int(i) for i in x] for x in column]
            texts = iter(codec.decode([x for x in lists if x is not None]))
            yield pd.Series([None if x is None else next(texts) for x in lists], dtype=object)

    return rows.withColumn(out, apply(F.col(ids_col)))

