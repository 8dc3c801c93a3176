import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from omicspark.llm import bpe_count, sentencepiece_codec

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "İstanbul ΣΑΣ ς", "é ÅΩ", "don't we'LL 123 a1b2", "\x1c\x1d\x85  x", "日本語テキスト 한국어", "🙂👍🏽", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "x" * 3000, "\x00", "ﬁ ß ẞ", "a​b", "word " * 500, "...!!!???", "▁ a▁b", "\n\n  \t x"]


@pytest.fixture(scope="module")
def counters():
    return {p: (bpe_count.BpeCounter(open(p, "rb").read()), Tokenizer.from_file(p)) for p in (WORDS, BYTES)}


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(counters, path, text):
    counter, library = counters[path]
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abcdethinorS'’ .<|endoftx>é1\t\n", max_size=80))
def test_counts_equal_the_library(counters, text):
    text = text.encode("utf-8", "ignore").decode()
    for counter, library in counters.values():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_memory_of_words_is_bounded(counters, monkeypatch):
    monkeypatch.setattr(bpe_count, "MEMO_WORDS", 3)
    counter = counters[WORDS][0]
    before = counter.count("one two three four five six seven")
    assert counter.count("one two three four five six seven") == before and len(counter.memo) <= 4


def test_unknown_files_are_refused():
    with pytest.raises(ValueError):
        bpe_count.BpeCounter(b'{"model": {"type": "Unigram"}}')


def test_count_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "the cat", 9), (3, "the cat", 9), (None, "é", 9), (4, "word " * 3000, 9)]
    found = bpe_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), WORDS).collect()
    assert sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == [
        (0, 2, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (3, 7, 2, False), (4, 15000, 3000, True),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_count.count_tokens(empty, WORDS).collect() == []


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(open(PIECES, "rb").read())


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(codec, text):
    assert codec.encode([text]) == codec.reference([text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abethin or é1\n", max_size=60), max_size=5))
def test_pieces_equal_the_library(codec, texts):
    texts = [t.encode("utf-8", "ignore").decode().replace("▁", "_") for t in texts]
    ids = codec.encode(texts)
    assert ids == codec.reference(texts)
    assert codec.decode(ids) == texts


@pytest.mark.parametrize("runs", range(1, 40))
def test_runs_of_spaces(codec, runs):
    text = "a" + " " * runs + "b"
    assert codec.encode([text]) == codec.reference([text])


def unigram(byte_fallback, squeeze):
    model = proto.ModelProto()
    known = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        known += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    known += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "▁the", "▁ca", "t", "ca", "▁cat", "s", "a", "c", "he", "th", "at", "e", "h"])]
    for piece, score, kind in known:
        added = model.pieces.add()
        added.piece, added.score, added.type = piece, score, kind
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte_fallback
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.escape_whitespaces = True
    return model.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_models(byte_fallback, squeeze):
    codec = sentencepiece_codec.Codec(unigram(byte_fallback, squeeze))
    texts = ["the cats", "cat  the", " the cat ", "chat é cat", "", "   ", "the\ncat"]
    assert codec.encode(texts) == codec.reference(texts)
    assert all(parity for _, _, parity in codec.round(texts))


def test_a_difference_is_noticed():
    codec = sentencepiece_codec.Codec(open(PIECES, "rb").read())
    pieces = [(p, i) for i, (p, _, _) in enumerate(codec.model.pieces)]
    wrong = {p: i for p, i in pieces} | {"▁the": 300, pieces[300][0]: dict(pieces)["▁the"]}
    model = sentencepiece_codec.models.BPE(wrong, sentencepiece_codec._merges(codec.model), unk_token="<unk>", byte_fallback=True)
    codec.words = Tokenizer(model)
    assert [parity for _, _, parity in codec.round(["of the sea", "of sea"])] == [False, True]


def test_a_cut_off_file_is_refused():
    with pytest.raises((ValueError, IndexError)):
        sentencepiece_codec.Model.parse(open(PIECES, "rb").read()[:-3])


def test_encode_and_decode_rows(spark):
    texts = {1: None, 2: "", 3: "Hello  wörld\n", 4: "x y " * 20_000, None: "日本", 5: "a▁b"}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(3, texts[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = sentencepiece_codec.encode(docs, PIECES)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = made.collect()
    assert len(found) == 7
    for r in found:
        assert r.ids == own.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.parity
        assert r.round_trip == (r.doc_id != 5)
    back = sentencepiece_codec.decode(made, PIECES).collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sentencepiece_codec.decode(nothing, PIECES).first().text is None
    assert sentencepiece_codec.encode(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab▁ é\n1", max_size=30), max_size=4))
def test_words_one_by_one_equal_the_whole_pipeline(codec, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    whole = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    made = codec.round(texts)
    assert codec.encode(texts) == whole
    assert [text for _, text, _ in made] == codec.decode(whole)
    assert [parity for _, _, parity in made] == [a == b for a, b in zip(whole, codec.reference(texts))]


def test_known_words_are_bounded(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "KNOWN_WORDS", 5)
    texts = ["one two three", "four five six seven eight", "one nine"]
    assert [codec.encode([t])[0] for t in texts] == codec.reference(texts)
    assert codec.encode(texts) == codec.reference(texts)
