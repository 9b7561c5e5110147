"""SentencePiece models run by the tokenizers library, without the model's own library.

The model file is a protobuf message and is read field by field here: pieces with scores and types,
the kind of model, byte fallback, and the normaliser's settings. From these a tokenizer is rebuilt:

- normaliser: the compiled character map if any, extra white space, the dummy prefix, and the
  metaspace mark in place of spaces;
- model: for a unigram model the pieces with their scores; for a BPE model the merges that the
  scores rank (each way of cutting a piece into two pieces is a merge; better scores merge first),
  with byte fallback in both;
- decoder: the reverse.

Texts are encoded in batches, which the library spreads over threads. No piece of the usual models
holds a metaspace mark after another character; then nothing joins across the start of a word, and
each different word goes through the rebuilt tokenizer, normaliser and all, once per worker process:
many words in one text, cut at the ids that start with the mark. The same ids go through its decoder,
whose result is compared with the words; a text decodes to itself when its words do, as decoding
works piece by piece. Parity with the original library, which gets every whole text, is verified on
every text (``verify=True``), as the registered query does.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers

from quarry.llm.common import table, text_or_empty
from quarry.llm.encoding import parts

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in either of the two tables that a worker process keeps.
MOST_WORDS = 400_000
#: Characters of words that are encoded in one text.
CHUNK_CHARS = 2000
#: Words with the spaces before them, and words at the start of a line.
_general = re.compile(r"\n[^ \n]*| +[^ \n]*").findall
_known: dict[str, Encoder] = {}


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_spaces: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; fixed-width values as bytes."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            x = data[i]
            i += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, i = data[i : i + n], i + n
        elif wire == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            out.kind, out.byte_fallback, out.unk_id = own.get(3, 1), bool(own.get(35, 0)), own.get(40, 0)
            out.suffix_spaces = bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            out.charsmap = own.get(2, b"")
            out.dummy_prefix, out.remove_extra_spaces, out.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if out.kind not in (1, 2):
        raise ValueError("only unigram and BPE models")
    if out.suffix_spaces or not out.escape_spaces:
        raise ValueError("spaces as suffixes or unescaped are not supported")
    if any(kind == USER_DEFINED for _, _, kind in out.pieces):
        raise ValueError("pieces defined by the user are not supported")
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model, the best first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in ids.items():
        score = model.pieces[i][1]
        for k in range(1, len(piece)):
            left, right = ids.get(piece[:k]), ids.get(piece[k:])
            if left is not None and right is not None:
                found.append((-score, i, left, right, piece[:k], piece[k:]))
    return [(x[4], x[5]) for x in sorted(found, key=lambda x: x[:4])]


def build(model: Model) -> Tokenizer:
    unk = model.pieces[model.unk_id][0]
    if model.kind == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(_two_or_more(), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE_MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE_MARK)])
    ends: list = [decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


def _two_or_more():
    from tokenizers import Regex

    return Regex(" {2,}")


class Encoder:
    """The rebuilt tokenizer, and the words that it has encoded and decoded already."""

    def __init__(self, path: str):
        self.path = path
        self.model = read_model(path)
        self.tokenizer = build(self.model)
        self.plain = self._plain(self.model)
        starts = [p.startswith(SPACE_MARK) for p, _, _ in self.model.pieces]
        if self.plain:
            self.newline = self.tokenizer.token_to_id("<0x0A>")
            starts[self.newline] = True
        self.starts = np.array(starts)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Words that decoding doesn't give back.
        self.bad: set[str] = set()
        self.original = None

    @staticmethod
    def _plain(m: Model) -> bool:
        """Whether no piece goes on past the start of a word or over a line end, so that each word's ids are its own."""
        texts = [p for p, _, k in m.pieces if k not in (CONTROL, UNKNOWN, BYTE)]
        return m.kind == 2 and m.byte_fallback and m.dummy_prefix and not m.charsmap and not m.remove_extra_spaces and all(SPACE_MARK not in p.lstrip(SPACE_MARK) and "\n" not in p for p in texts)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _known:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
            _known[path] = Encoder(path)
        return _known[path]

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words of a text. A word stands for the space before it (the dummy prefix, for the first) and itself, with further spaces in front; one that starts with a line end, for itself."""
        words = text.replace("\n", " \n").split(" ") if text else []
        return words if "" not in words else [w.removeprefix(" ") for w in _general(" " + text)]

    def _learn(self, words: list[str]) -> None:
        """Encode words with the rebuilt tokenizer, many in one text, and decode them: a word begins at each id that starts with the mark or is a line end."""
        simple, single, size = [[]], [], 0
        for w in words:
            if not w or w[0] == " ":
                single.append(w)
            elif w[0] == "\n" and not simple[-1]:
                simple[-1] += ["a", w]  # a text's first word takes the dummy prefix
            else:
                simple[-1].append(w)
                size += len(w)
                if size > CHUNK_CHARS:
                    simple.append([])
                    size = 0
        texts = ["".join(w if w[0] == "\n" else f" {w}" for w in own)[1:] for own in simple if own]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        for own, text, ids, again in zip(filter(None, simple), texts, found, back, strict=True):
            ids = np.array(ids, "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(own) or again != text:
                single += own
                continue
            raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), 4 * len(ids)]
            for w, i, j in zip(own, (at * 4).tolist(), ends, strict=True):
                self.kept[w] = raw[i:j]
        for w in single:
            # Behind a word comes a line end, before a line end a dummy prefix: both are one id.
            ids = self.tokenizer.encode(w + "\n", add_special_tokens=False).ids
            ids = ids[1:-1] if w[:1] == "\n" else ids[:-1]
            self.kept[w] = array("I", ids).tobytes()
            if self.tokenizer.decode([*([self.tokenizer.token_to_id(SPACE_MARK)] if w[:1] == "\n" else []), *ids], skip_special_tokens=False) != w:
                self.bad.add(w)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, little-endian unsigned 32-bit, and whether decoding them gives the text back."""
        if not self.plain:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            return [array("I", ids).tobytes() for ids in found], [x == t for x, t in zip(back, texts, strict=True)]
        if len(self.kept) > MOST_WORDS:
            self.older, self.kept = self.kept, {}
            self.bad &= self.older.keys()
        kept, cut, marked = self.kept, [], []
        for t in texts:
            marked.append(SPACE_MARK in t)
            cut.append(self.cut(t.replace(SPACE_MARK, " ") if marked[-1] else t))
        todo = []
        for w in set(chain.from_iterable(cut)).difference(kept):
            if (old := self.older.get(w)) is not None:
                kept[w] = old
            else:
                todo.append(w)
        self._learn(todo)
        get, bad = kept.__getitem__, self.bad
        return [b"".join(map(get, words)) for words in cut], [not m and (not bad or bad.isdisjoint(words)) for m, words in zip(marked, cut, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids, by the library."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def verify(self, texts: list[str]) -> list[bytes]:
        """The ids that the original library gives."""
        if self.original is None:
            from sentencepiece import SentencePieceProcessor

            self.original = SentencePieceProcessor(model_file=self.path)
        encode = self.original.EncodeAsIds
        return [array("I", encode(t)).tobytes() for t in texts]


def encode_documents(docs: DataFrame, model: str, verify: bool = False, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, then parity if verify, then ids array<int> if with_ids.

    A null or empty text has no ids. round_trip: decoding gives the text back (always, for a model
    with byte fallback that leaves spaces alone, but for texts that aren't valid Unicode). parity:
    the ids are the original library's. Repeated rows are encoded each. Only doc_id and text are
    read. An empty table gives no rows.
    """
    names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"] + ["parity"] * verify + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for b in batches:
            texts = b["text"].to_pylist()
            for i, j in parts(texts):
                own = texts[i:j]
                raw, same = encoder.encode(own)
                ids = [np.frombuffer(r, "<u4") for r in raw]
                columns = [b["doc_id"][i:j], pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())]
                if verify:
                    columns.append(pa.array([x == y for x, y in zip(raw, encoder.verify(own), strict=True)], pa.bool_()))
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {"n_tokens": "long", "ids_crc32": "long", "round_trip": "boolean", "parity": "boolean", "ids": "array<int>", "doc_id": docs.schema["doc_id"].dataType.simpleString()}
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of each row (doc_id, ids), by the rebuilt decoder. Null ids give an empty text; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for b in batches:
            ids = [x or [] for x in b["ids"].to_pylist()]
            for i, j in parts(ids):
                yield pa.RecordBatch.from_arrays([b["doc_id"][i:j], pa.array(encoder.decode(ids[i:j]), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), verify=True, with_ids=False)
