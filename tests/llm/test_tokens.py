"""Encoding against the library, piece by piece and through Spark."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from solvenza.llm.packing import Packer, packed, token_ids
from solvenza.llm.tokens import bpe, encoded, read_spec

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe(read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(packed_ids):
    return np.frombuffer(packed_ids, "<u4").tolist()


CASES = [
    "", " ", "  ", "a  b", "\n ", " \n", "a \n b", "'s'll 've", "aaaa" * 1000, " " * 50 + "x", "x" + " " * 51,
    "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "\x1c a\x1c b \x1c", "日本語 テスト 𝔸", "a​b ²½ªº",
]


@pytest.mark.parametrize("text", CASES)
def test_ids_equal_the_library(coder, library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids_of(coder.encode(text)) == expected
    assert coder.decode(coder.encode(text)) == library.decode(expected, skip_special_tokens=False)
    assert token_ids(text, read_spec(PATH)) == coder.encode(text)


def test_random_texts_equal_the_library(coder, library):
    random.seed(5)
    letters = list("abcdefgh  \n\t'sS1234.,!é日\x1c ")
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(1, 30)))
        assert ids_of(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_to_itself(coder):
    for number, raw in list(coder.texts.items())[::7]:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert coder.decode(coder.encode(text)) == text


def test_last_token_of_every_prefix_is_that_of_its_encoding(coder):
    piece = " unbelievableness"
    last = coder.last_tokens(piece)
    for stop in range(1, len(piece) + 1):
        assert coder.ids[last[stop - 1]] == ids_of(coder.encode_piece(piece[:stop]))[-1]


def test_encoded_rows(documents, library):
    rows = {(r.doc_id, r.ids_sha256): r for r in encoded(documents(EDGES), PATH).collect()}
    assert len(rows) == len(set((i, t or "") for i, t in EDGES))
    for doc_id, text in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = rows[doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(documents):
    assert encoded(documents([]), PATH).collect() == []
    assert packed(documents([]), PATH).collect() == []


def test_packing_covers_every_id_once_without_padding(documents):
    many = EDGES + [(100 + i, "word " * (i * 7 % 900)) for i in range(150)]
    rows = packed(documents(many).coalesce(2), PATH, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        if r.doc_id and r.doc_id >= 100:
            by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        offset = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == offset
            offset += p.length
        assert offset == pieces[0].sequence_tokens and offset & (offset - 1) == 0
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda p: p.start)
        text = dict(many)[doc_id]
        whole = token_ids(text, read_spec(PATH)) + (1).to_bytes(4, "little")
        assert b"".join(bytes(p.ids) for p in pieces) == whole
        assert all(p.doc_tokens == len(whole) // 4 for p in pieces)
    steps = {}
    for pieces in by_sequence.values():
        steps.setdefault(pieces[0].step_id, set()).add(pieces[0].sequence_tokens)
    assert all(len(sizes) == 1 for sizes in steps.values())


def test_long_windows_take_shorter_documents_whole():
    packer = Packer(0, tiers=(4, 8), step_tokens=8)
    rows = []
    for doc_id, n in (("a", 7), ("b", 1), ("c", 3), ("d", 1), ("e", 20)):
        rows += packer.add(doc_id, bytes(4 * n))
    rows += packer.finish()
    windows = {}
    for doc_id, start, length, _, _, sequence, *_ in rows:
        windows.setdefault(sequence, []).append((doc_id, start, length))
    assert [("e", 0, 8)] in windows.values() and [("e", 8, 8)] in windows.values()
    assert any({d for d, _, _ in w} == {"a", "b"} or {d for d, _, _ in w} == {"a", "d"} for w in windows.values())
    assert sum(n for w in windows.values() for _, _, n in w) == 32


def test_tiers_must_be_powers_of_two():
    with pytest.raises(ValueError):
        Packer(0, tiers=(100, 200))


def seconds(fn):
    import time
    begin = time.perf_counter()
    fn()
    return time.perf_counter() - begin


def test_a_long_piece_takes_linear_time(coder, library):
    short, long = "xq" * 100_000, "xq" * 1_000_000
    assert ids_of(coder.encode(short)) == library.encode(short, add_special_tokens=False).ids
    first = min(seconds(lambda: coder.encode(short)) for _ in range(3))
    assert seconds(lambda: coder.encode(long)) < 40 * first


def test_a_long_document_packs_in_linear_time():
    def pack(tokens):
        packer = Packer(0)
        return sum(1 for _ in [*packer.add(1, bytes(4 * tokens)), *packer.finish()])

    assert pack(5 * 2048 + 3) == 7
    first = min(seconds(lambda: pack(500_000)) for _ in range(3))
    assert seconds(lambda: pack(5_000_000)) < 40 * max(first, 0.005)
