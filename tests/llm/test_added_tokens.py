"""Texts that hold a tokenizer's own added tokens, against a tokenizer that nothing has touched."""

import struct
import zlib

import pytest

from segmill.llm import packing, tokenfiles
from segmill.llm.wordbpe import encoder

P = pytest.importorskip("public_tokenizers")
FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
TEXTS = [" <|endoftext|>", "<|endoftext|>", "a <|startoftext|> b<|endoftext|><|endoftext|>\n c", "<|EndOfText|> <|endoftext", "é <|endoftext|> 漢字", "<|endoftext|>ſ", "plain words"]


def untouched(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(file))


@pytest.mark.parametrize("file, kind", FILES)
def test_added_tokens_are_one_id(file, kind):
    library = untouched(file)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert library.token_to_id("<|endoftext|>") in want[0]
    assert encoder(P.path(file), kind).encode(TEXTS) == [struct.pack(f"<{len(i)}I", *i) for i in want]


def test_token_files_and_packing_with_added_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    start = 0
    got = sorted(map(tuple, tokenfiles.read_documents(tokenfiles.write_token_files(df, P.path(FILES[0][0]))).collect()))
    for (doc_id, s, n, crc, _), text in zip(got, TEXTS, strict=True):
        ids = untouched(FILES[0][0]).encode(text, add_special_tokens=False).ids + [2]
        assert (s, n, crc) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), doc_id
        start += n
    word = untouched(FILES[1][0])
    packed = packing.pack_documents(df, P.path(FILES[1][0])).collect()
    lengths = {k: sum(r["length"] for r in packed if r["doc_id"] == k) for k in range(len(TEXTS))}
    plain = {k: len(word.encode(t, add_special_tokens=False).ids) for k, t in enumerate(TEXTS)}
    assert len({lengths[k] - plain[k] for k in plain}) == 1
