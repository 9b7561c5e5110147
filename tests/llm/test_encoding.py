"""Word-wise encoding, token shards, and SentencePiece models in the tokenizers library."""

import glob
import math
import struct
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sstable
from quarry.llm.encoding import WordEncoder, parts
from quarry.llm.sentencepiece import Encoder, Model, build, decode_documents, encode_documents, merges, model_path, read_model
from tests.llm.helpers import awkward, docs, long_text

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "İstanbul ΣΑΣ", "a<|endoftext|>b", "don't  it's x​y", "'s'd ''ll 12³ ½x_y", "éa ﬁ", "ẞß ǅ Ä", "x\x1cy\x85z", "日本語 한국어 \U0001f600", "· ·· ·", "snake_case __x 1_000", "²³ ¹²"]
alphabet = st.sampled_from(list("abcdeEÉéßΣσИи.,'!_- \n\t0123456789²½日本ー・ ́‍\U0001f600<|>▁")) | st.characters(exclude_categories=["Cs"])


def whole(text):
    return array("I", WordEncoder.of(WORD_BPE).tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_words_give_the_ids_of_whole_texts():
    texts = ODD + [long_text(k, 300) for k in range(5)]
    e = WordEncoder.of(WORD_BPE)
    assert e.words is not None
    assert e.encode(texts) == [whole(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=60))
def test_any_text_gets_the_ids_of_the_whole_text(text):
    assert WordEncoder.of(WORD_BPE).encode([text]) == [whole(text)]


def test_kept_words_are_bounded(monkeypatch):
    from quarry.llm import encoding

    e = WordEncoder(WORD_BPE)
    monkeypatch.setattr(encoding, "MOST_WORDS", 10)
    texts = [long_text(k, 30) for k in range(10)]
    assert [e.encode([t])[0] for t in texts] == [whole(t) for t in texts]
    assert len(e.kept) <= 41 and len(e.older) <= 41


def test_other_tokenizers_encode_whole():
    e = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.words is None and e.encode(["Hello there"]) == [array("I", e.tokenizer.encode("Hello there", add_special_tokens=False).ids).tobytes()]


def test_parts():
    assert parts(["a" * 5, "b" * 5, "", "c" * 20, "d"], 10) == [(0, 2), (2, 4), (4, 5)]
    assert parts([]) == []


def test_shards(spark):
    rows = awkward() + [(50 + i, long_text(i, 50 + i), "en", "s", 1) for i in range(200)]
    df = docs(spark, rows).repartition(5).selectExpr("*", "1 as start", "2 as n_tokens", "3 as shard")
    manifest = sstable.write_shards(df, WORD_BPE)
    got = [tuple(r) for r in sstable.read_shards(manifest).collect()]
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append(whole(text or "") + array("I", [1]).tobytes())
    assert len(got) == len(rows)
    at = 0
    for doc_id, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        assert (n, crc) in [(len(x) // 4, zlib.crc32(x)) for x in ids[doc_id]]
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    shards = [sstable.Shard(r.shard) for r in manifest.collect()]
    for doc_id, want in ids.items():
        found = [x.astype("<u4").tobytes() for s in shards for x in s.get(doc_id)]
        assert sorted(found) == sorted(want)
    assert not any(len(x) for s in shards for x in s.get(123456))


def test_no_shards(spark):
    assert sstable.token_shards(docs(spark, []), WORD_BPE).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_shard_file(tmp_path, monkeypatch, width):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(1)
    entries = [(i, rng.integers(0, 60_000, rng.integers(0, 30)).astype("<u4")) for i in sorted(rng.choice(10_000, 300, replace=False).tolist())]
    entries = [(-(1 << 63), np.arange(3, dtype="<u4")), (-5, np.zeros(0, "<u4")), *entries, ((1 << 63) - 1, np.arange(2, dtype="<u4"))]
    path = f"{tmp_path}/x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, width)
        for i, ids in entries:
            w.add(sstable.key_of(i), ids.tobytes())
        w.close()
    s = sstable.Shard(path)
    assert len(s.places) > 10 and s.entries == len(entries) and s.ids == sum(len(x) for _, x in entries)
    assert [(i, x.tolist()) for i, x in s.scan()] == [(i, x.tolist()) for i, x in entries]
    known = dict(entries)
    for i in [*known, *range(0, 10_000, 37)]:
        assert [x.tolist() for x in s.get(i)] == ([known[i].tolist()] if i in known else [])
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(path).scan())
    open(path, "wb").write(data[:-1])
    with pytest.raises(ValueError):
        sstable.Shard(path)


def test_filter_rejects_most_absent_keys(tmp_path):
    path = f"{tmp_path}/x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 4)
        for i in range(2000):
            w.add(sstable.key_of(2 * i), b"")
        w.close()
    s = sstable.Shard(path)
    passed = sum(all(s.bits[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(2 * i + 1), s.n_bits)) for i in range(2000))
    assert passed < 60


def test_lost_tasks_leave_only_stray_files(spark):
    """A file that no manifest row names is never read."""
    manifest = sstable.write_shards(docs(spark), WORD_BPE)
    first = manifest.first().shard.removeprefix("file://")
    with open(f"{first.rpartition('/')[0]}/.half.sst", "wb") as f:
        f.write(b"half")
    assert sstable.read_shards(manifest).count() == len(awkward())
    assert not glob.glob(f"{first.rpartition('/')[0]}/.shard*.sst")


def test_piece_model_reads():
    m = read_model(model_path())
    assert (len(m.pieces), m.kind, m.byte_fallback, m.unk_id, m.remove_extra_spaces, m.dummy_prefix) == (32_000, 2, True, 0, False, True)
    assert m.pieces[1][0] == "<s>" and merges(m)[0][0] + merges(m)[0][1] == "▁t"


def test_piece_parity_and_round_trip():
    e = Encoder.of(model_path())
    texts = [*ODD, "a  b   c", "\n\n x", "<s> </s> <unk> <0x41>", "  lead", "trail  ", "x\x00y", *[long_text(k, 400) for k in range(4)]]
    assert e.plain
    raw, same = e.encode(texts)
    assert raw == e.verify(texts) and all(same)
    assert e.decode([np.frombuffer(x, "<u4").tolist() for x in raw]) == texts
    library = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert library == e.verify(texts)
    assert [e.tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in library] == texts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=60))
def test_any_text_has_piece_parity(text):
    e = Encoder.of(model_path())
    raw, same = e.encode([text])
    assert raw == e.verify([text]) and same == [e.decode([np.frombuffer(raw[0], "<u4").tolist()])[0] == text] == ["▁" not in text]


def proto(number, value) -> bytes:
    """A field of a protobuf message: varint, 4-byte float or bytes."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram_file(path, **normaliser):
    """A unigram model with byte fallback, of single letters and the pieces of a public model."""
    said = read_model(model_path()).pieces
    pieces = [p for p in said if p[2] != 1] + [(p, -2.0 - 0.37 * math.log(2 + i), 1) for i, (p, _, kind) in enumerate(said) if kind == 1 and len(p) < 9 and i % 3]
    data = b"".join(proto(1, proto(1, p.encode()) + proto(2, s) + proto(3, kind)) for p, s, kind in pieces)
    data += proto(2, proto(3, 1) + proto(35, 1)) + proto(3, b"".join(proto({"dummy": 3, "squeeze": 4}[k], v) for k, v in normaliser.items()))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("normaliser", [{"dummy": 1, "squeeze": 0}, {"dummy": 0, "squeeze": 0}, {"dummy": 1, "squeeze": 1}])
def test_unigram_parity(tmp_path, normaliser):
    e = Encoder(unigram_file(tmp_path / "u.model", **normaliser))
    assert not e.plain and e.model.kind == 1
    texts = [*[t for t in ODD if t], "a  b   c", "x\ny z", "  lead", "trail  ", "日本 語😀", *[long_text(k, 400) for k in range(4)]]
    raw, same = e.encode(texts)
    assert raw == e.verify(texts)
    if not normaliser["squeeze"]:
        assert all(same)


def test_kept_pieces_are_bounded(monkeypatch):
    from quarry.llm import sentencepiece

    e = Encoder(model_path())
    monkeypatch.setattr(sentencepiece, "MOST_WORDS", 10)
    monkeypatch.setattr(sentencepiece, "CHUNK_CHARS", 7)
    for k in range(10):
        text = long_text(k, 30) + "\n" + long_text(k + 1, 5)
        assert e.encode([text])[0] == e.verify([text])
    assert len(e.kept) <= 50 and len(e.older) <= 50


def test_unigram_model_keeps_scores():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -6.0, 1)]
    t = build(Model(pieces=pieces, kind=1, byte_fallback=False, unk_id=0))
    assert t.encode("ab  ab", add_special_tokens=False).tokens == ["▁", "ab", "▁", "ab"]
    assert t.decode(t.encode("ab a").ids) == "ab a"


def test_encode_documents(spark):
    df = docs(spark).selectExpr("*", "1 as ids", "2 as parity", "3 as n_tokens")
    got = encode_documents(df, model_path(), verify=True).collect()
    assert len(got) == len(awkward()) and all(r.parity and r.round_trip for r in got)
    e = Encoder.of(model_path())
    texts = {}
    for doc_id, text, *_ in awkward():
        texts.setdefault(doc_id, []).append(text or "")
    for r in got:
        raw = np.array(r.ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_crc32) == (len(r.ids), zlib.crc32(raw)) and raw in e.verify(texts[r.doc_id])
    back = decode_documents(encode_documents(df, model_path()), model_path()).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, *_ in awkward())
    none = encode_documents(docs(spark, []), model_path())
    assert none.count() == 0 and decode_documents(none, model_path()).count() == 0
