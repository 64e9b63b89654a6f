import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import edge_texts, same_rows
from tickloom.llm import id_coder, token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_coder_round_trips():
    random = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 1000, 4097, 70_001, id_coder.LANES * 70):
        for ids in (np.minimum(random.zipf(1.3, n), 50_000), random.integers(0, id_coder.MOST_IDS, n), np.zeros(n, np.int64), np.arange(n) % 700):
            assert (id_coder.decode(id_coder.encode(ids)) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400))
def test_coder_on_any_ids(ids):
    assert id_coder.decode(id_coder.encode(np.array(ids))).tolist() == ids


def test_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 500), 400)
    assert len(id_coder.encode(ids)) < len(ids) * 0.5


def test_damage_is_found():
    block = id_coder.encode(np.arange(1000) % 77)
    for at in (0, 5, 20, 30, len(block) - 3):
        with pytest.raises(ValueError):
            id_coder.decode(block[:at] + bytes([block[at] ^ 0x55]) + block[at + 1:])
    with pytest.raises(ValueError):
        id_coder.decode(block[:-1])
    whole = b"".join(f + b"\n" for f in token_files.frames_of(iter([(1, np.arange(9)), (None, np.array([2]))])))
    assert [(d, n) for d, n, _, _ in token_files.read_frames(whole)] == [(1, 9), (None, 1)]
    for wrong in (whole[:-1], whole[:10], whole[:20] + b"\xff" + whole[21:]):
        with pytest.raises(ValueError):
            list(token_files.read_frames(wrong))


def test_documents_over_several_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    docs = [(i, np.arange(n) % 50) for i, n in enumerate([3, 250, 97, 100, 1, 99])]
    whole = b"".join(f + b"\n" for f in token_files.frames_of(iter(docs)))
    assert whole.count(token_files.MAGIC) >= 6
    wanted = [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in docs]
    assert [(d, n, c) for d, n, c, _ in token_files.read_frames(whole)] == wanted


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    texts = [t or "" for _, t, _ in edge_texts()] + [
        " ", "a  b", "\n", "a \nb", "x\ty", "a <|endoftext|> b", "don't 's  go", " lead", "trail ", "a b c", "a\n\nb c", "a b ᠎ c", "a\x1cb c", "1 2\n3",
        "hello <|endoftext|> world", "x<|endoftext|>y z", "<|endoftext|>", "<|endoftext| >", "a <|endoftext|><|endoftext|>\n b"]
    assert tokenizer.encode(texts[-5], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    coder = token_files.PieceEncoder(tokenizer)
    for _ in range(2):
        found = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)]
        assert found == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_table_is_bounded_by_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_BYTES", 50_000)
    coder = token_files.PieceEncoder(tokenizer, {})
    for low in range(0, 5000, 100):
        texts = [f"word{i} thing{i} other" for i in range(low, low + 100)]
        found = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)]
        assert found == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert coder.table[token_files.HELD] < 50_000 + 200 * 250 and len(coder.table) < 800


def test_round_trip(edge_docs, no_docs, tokenizer):
    found = token_files.round_trip(edge_docs, FILE).collect()
    wanted = []
    for doc_id, text, _ in edge_texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    same_rows([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found], wanted)
    rows = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(no_docs, FILE).count() == 0
