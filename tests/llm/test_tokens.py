import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pneuma.llm import bpe, token_files

from .conftest import ODD

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDY = st.text(alphabet=st.sampled_from("ab Z.\n\t'!é日😀1  　\r's"), max_size=60)


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_every_vocabulary_entry_is_one_piece():
    codec = bpe.Codec.get(RANKS, P.PATTERN)
    assert all(codec._merge(t) == [r] for r, t in list(codec.token_of.items())[:3000])


@settings(max_examples=300, deadline=None)
@given(WORDY)
def test_bpe_as_tiktoken(tik, text):
    codec = bpe.Codec.get(RANKS, P.PATTERN)
    ids = np.frombuffer(codec.encode([text])[0], "<u4")
    assert ids.tolist() == tik.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(WORDY)
def test_file_encoder_as_tokenizers(hf, text):
    got = token_files.text_encoder(VOCABULARY, P.PATTERN)([text + "<|endoftext|>", text])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        e.ids for e in hf.encode_batch([text + "<|endoftext|>", text], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDY | st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<|", " "]), max_size=6).map("".join))
def test_file_encoder_matches_added_tokens(text):
    from tokenizers import Tokenizer
    default = Tokenizer.from_file(VOCABULARY)
    texts = [text, "a<|endoftext|>b", "plain", "x <|endoftext|><|endoftext|> y\n"]
    got = token_files.file_encoder(VOCABULARY, P.PATTERN)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        e.ids for e in default.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", [{"lstrip": True}, {"rstrip": True}, {"single_word": True}, {}])
def test_added_tokens_of_other_kinds(tmp_path, kind):
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    t.add_tokens([AddedToken("<|x|>", normalized=False, **kind), AddedToken("<|x|>y", normalized=False)])
    path = str(tmp_path / "v.json")
    t.save(path)
    texts = ["a <|x|> b", "a<|x|>yz <|x|>", "<|endoftext|><|x|>", "none"]
    got = token_files.file_encoder(path, P.PATTERN)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files_hold_added_tokens(spark, make_docs):
    from tokenizers import Tokenizer
    default = Tokenizer.from_file(VOCABULARY)
    items = [(1, "a<|endoftext|>b"), (2, "after"), (3, "<|endoftext|>")]
    path, manifest = token_files.write_token_files(make_docs(items), VOCABULARY, P.PATTERN)
    got = token_files.read_token_files(manifest, path, with_ids=True).toPandas().sort_values("start")
    ids = [default.encode(t, add_special_tokens=False).ids + [2] for _, t in items]
    assert [list(x) for x in got.ids] == ids and got.start.tolist() == [0, 4, 4 + len(ids[1])]


def test_ranks_with_gaps():
    ranks = {bytes([i]): 3 * i for i in range(256)} | {b"ab": 1000, b"abc": 1001}
    codec = bpe.Codec(ranks, P.PATTERN)
    assert np.frombuffer(codec.encode(["abcab"])[0], "<u4").tolist() == [1001, 1000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 60), max_size=700), st.sampled_from([8, 128, 1024]))
def test_blocks_round_trip(ids, block):
    a = np.array(ids, dtype=np.uint32)
    body, starts = token_files.pack_blocks(a, block)
    assert token_files.unpack_blocks(body, starts, len(a), block).tolist() == ids
    if len(starts) > 2:
        assert token_files.unpack_blocks(body, starts, len(a), block, 1, 2).tolist() == ids[block:2 * block]


def test_exceptions_are_few():
    a = np.arange(1024, dtype=np.uint32) % 16
    a[::100] = 2 ** 31
    body, _ = token_files.pack_blocks(a)
    assert len(body) == 7 + 1024 * 4 // 8 + 11 * 6


def test_token_files(spark, make_docs, hf):
    for items in (ODD, [(i, f"text {i} " * (i % 7)) for i in range(300, 0, -1)], []):
        docs = make_docs(items, extra=True).repartition(4) if items else make_docs(items)
        path, manifest = token_files.write_token_files(docs, VOCABULARY, P.PATTERN, shard_ids=500)
        got = token_files.read_token_files(manifest, path, with_ids=True).toPandas().sort_values("start")
        want = sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        ids = [hf.encode(t or "", add_special_tokens=False).ids + [2] for _, t in want]
        assert [None if d != d else d for d in got.doc_id] == [d for d, _ in want]
        assert [list(x) for x in got.ids] == ids
        assert got.n_tokens.tolist() == [len(x) for x in ids]
        assert got.start.tolist() == [sum(map(len, ids[:i])) for i in range(len(ids))]
        assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_encode_decode(spark, make_docs, tik):
    got = bpe.encode_decode(make_docs(ODD, extra=True), RANKS, P.PATTERN).toPandas()
    assert got.round_trip.all() and len(got) == len(ODD)
    assert sorted(got.n_tokens) == sorted(len(tik.encode_ordinary(t or "")) for _, t in ODD)
    assert bpe.encode_decode(make_docs([]), RANKS, P.PATTERN).count() == 0
    ids = {tuple(r.ids) for r in bpe.encode_ids(make_docs(ODD), RANKS, P.PATTERN).collect()}
    assert ids == {tuple(tik.encode_ordinary(t or "")) for _, t in ODD}


def test_piece_table_against_a_dictionary():
    """Pieces of every kind, few places, and tables that fill up and begin anew."""
    import regex

    from pneuma.llm import units
    rng = random.Random(11)
    made = []

    def word(w):
        made.append(w)
        return b"".join(ord(c).to_bytes(4, "little") for c in w)

    words = ["a", "", "ab", "ba", "é", "日本", "x.", "don't", "a" * 60, "\tb", "9"] + ["".join(rng.choices("abc", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(60)] + ["", " ", "a  b", "\n c", "z" * 5000]
    pattern = P.PATTERN
    want = [b"".join(ord(c).to_bytes(4, "little") for w in regex.findall(pattern, t) for c in w) for t in texts]
    for limit in (1, 50, 1_000_000):
        enc = units.TextEncoder(pattern, word, max_pieces=limit, max_words=20)
        for together in (1, 300, 1 << 19):
            units.TOGETHER_CHARS, kept = together, units.TOGETHER_CHARS
            try:
                assert enc(texts) == want and enc(texts[::-1]) == want[::-1]
            finally:
                units.TOGETHER_CHARS = kept
        if limit == 1_000_000:
            plain = [" ".join(t.split()) for t in texts]
            first = enc(plain)
            seen = len(made)
            assert enc(plain) == first and len(made) == seen  # all pieces are held
