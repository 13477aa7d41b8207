from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import SF_DIR, load

from tallyline.llm import rans, token_files
from tallyline.llm.queries import QUERIES, tokenizer_path
from tallyline.llm.tokens import Encoder
from tallyline.session import scratch_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(plain, text) -> bytes:
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def test_query_agrees_with_plain_encoding(spark, plain):
    rows = load(spark, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    found = {row.doc_id: row for row in QUERIES["op10_token_files"](spark, SF_DIR).collect()}
    start = 0
    for row in rows:
        ids, one = ids_of(plain, row.text), found[row.doc_id]
        assert (one.start, one.n_tokens, one.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert len(found) == len(rows)


def test_ids_come_back_in_order_from_many_files(spark, plain):
    rows = [(n * 7 % 101 - 50, f"text {n} " * (n % 9)) for n in range(101)] + [(3, None), (3, "a"), (3, "a"), (None, "b"), (None, "")]
    path = scratch_path(spark, "ids")
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA + ", tie int, file string").repartition(5)
    token_files.write_ids(frame, path, tokenizer_path(), file_tokens=40)
    found = token_files.with_starts(token_files.read_ids(spark, path)).orderBy("start").collect()
    order = [row.doc_id for row in found]
    assert order == sorted(order, key=lambda ident: (ident is not None, ident or 0))
    assert [row.start for row in found] == np.cumsum([0] + [row.n_tokens for row in found[:-1]]).tolist()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in found), key=repr) == sorted(((i, ids_of(plain, t)) for i, t in rows), key=repr)
    assert len({(row.partition, row.number) for row in found}) > 10


def test_empty_table(spark):
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_damage_is_found():
    tokens = np.arange(100_000, dtype="<u4") % 977
    whole = token_files.file_bytes(0, 0, [5, None], [tokens.tobytes(), b""]) + b"\n"
    first, second = token_files.file_documents(whole)
    assert first["ids"] == tokens.tobytes() and second["doc_id"] is None and second["n_tokens"] == 0
    broken = bytearray(whole)
    broken[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.file_documents(bytes(broken)))


@pytest.mark.parametrize("size", [1, 63, 64, 65, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 5])
def test_blocks_are_independent(size):
    symbols = np.minimum(np.random.default_rng(size).zipf(1.2, size), 5000) - 1
    counts = np.bincount(symbols, minlength=5000) + 1
    frequencies = rans.scaled(counts)
    blocks = rans.encode(symbols, frequencies)
    sizes = token_files.block_sizes(size).tolist()
    assert (rans.decode(blocks, sizes, frequencies) == symbols).all()
    assert (rans.decode(blocks[-1:], sizes[-1:], frequencies) == symbols[size - sizes[-1] :]).all()


@pytest.mark.parametrize("counts", [[1], [10**12] + [1] * 300_000, [3] * 400_000, [5, 1, 10**6]])
def test_frequencies_fill_the_table(counts):
    found = rans.scaled(np.array(counts))
    assert found.sum() == 1 << rans.SCALE and found.min() >= 1


def test_words_encoded_alone_make_up_the_text(plain):
    import random

    rng = random.Random(5)
    bits = ["a", "b ", "  ", " ", "\n", "\t", ".", ",", "'s", "é", "Ł", "ß", "1", "23", " ", "\x1c", "<|endoftext|>", "It", "don't", "中", "😀"]
    bits += ["\x00", "\x85", "ŉ", "ª", "²", "×", "word ", "###", " it's", "a\nb", "#\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["", " ", "\n", " a ", "a  b", "x\n y"]
    encoder = Encoder(tokenizer_path())
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        wanted = [np.array(one.ids, dtype="<u4").tobytes() for one in plain.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == wanted
