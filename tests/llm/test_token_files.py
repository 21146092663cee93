import sys
import zlib
from struct import pack as packed

import pytest

sys.path.insert(0, "/opt/tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tablewright.llm.packing import pack, piece_lengths  # noqa: E402
from tablewright.llm.tokenfiles import read_token_files, with_crc, write_token_files  # noqa: E402
from tablewright.llm.tokenizing import Encoder  # noqa: E402


def direct(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(packed(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_whole_texts(rows, name):
    encode, own = direct(name), Encoder(public_tokenizers.path(name), remembered=50)
    hard = ["a  b", " a", "a ", "  ", "a \n b", "a\n b", "a  b", "　 x 　y", "x 's it's", "1 2  34", "a ́b", "Σ ΟΔΟΣ Σ", "  z", "a\t b \tc", "é è", "\x85 q"]
    for text in [t for _, t in rows if t] + hard:
        ids = encode(text)
        assert own.encode(text.encode()) == packed(f"<{len(ids)}I", *ids), text[:60]


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    back = read_token_files(spark, str(tmp_path / "t"))
    got = sorted(back.select("doc_id", "start", "n_tokens", "ids").collect(), key=lambda r: r["start"])
    encode = direct("byte_bpe_50k.json")
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((i or -1, encode(t) + [2]) for i, t in rows)
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    sums = {(r["start"], r["ids_crc32"]) for r in with_crc(back.select("start", "ids")).collect()}
    assert sums == {(r["start"], crc(r["ids"])) for r in got}


def test_token_files_have_dictionaries_and_page_indexes(docs, tmp_path):
    import pyarrow.parquet as pq

    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    for file in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            columns = [meta.row_group(k).column(c) for c in range(meta.num_columns)]
            assert all(c.has_column_index and c.has_offset_index for c in columns if c.path_in_schema != "ids.list.element" and c.statistics.has_min_max)
            assert any("DICTIONARY" in e for c in columns if c.path_in_schema == "ids.list.element" for e in c.encodings)


def test_empty_tables(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(docs.limit(0), str(tmp_path / "t"), path, 2)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert pack(docs.limit(0), None, path, 1).count() == 0


def test_piece_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        made = piece_lengths(n, 2048)
        assert sum(made) == n and all(x & (x - 1) == 0 and x <= 2048 for x in made)
        assert len(made) == n // 2048 + (n % 2048).bit_count()


def test_packing(docs, rows):
    encode = direct("word_bpe_49k.json")
    got = pack(docs, None, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by_id = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_id] == sorted(r["length"] for r in got)  # buckets
    assert all(r["offset"] == 0 and r["length"] == len(r["ids"]) for r in got)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(encode(t) + [1])
    for i, texts in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        if len(texts) == 1:
            assert [x for r in own for x in r["ids"]] == texts[0]
            assert {r["doc_tokens"] for r in own} == {len(texts[0])}
        else:
            assert sum(r["length"] for r in own) == sum(map(len, texts))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_random_strings(name):
    import random

    draw, own = random.Random(5), Encoder(public_tokenizers.path(name), remembered=300)
    pieces = ["a", "B", "the", "Élan", "ß", "é", "é", "İ", "Σ", "ς", "한", "中", "ก็", "́", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", ".", ",", ".,", "...", "'s", "'S", "1", "23", "!", "?!"]
    pieces += ["<|endoftext|>", " ", " ", "　", "\x85", "\x1c", "‍", "😀", "_", "ﬁ", "Å", "K", "ſ", "\x00"]
    for _ in range(5000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25))).encode()
        assert own.encode(text) == own.whole(text), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together_ask_for_a_part_once(name):
    import random

    import numpy as np

    draw, own = random.Random(9), Encoder(public_tokenizers.path(name), remembered=300)
    pieces = ["a", "B", "the", "Élan", "Ⱥb", "ǆ", "İ", "Σ", "한", "́", " ", " ", "  ", "\n", " \n", "\t", ".", "%%%", "&.", "?!", "'s", "%'s", "_", "7", "　", "\xa0", "ŉ", "<|endoftext|>"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(25))).encode() for _ in range(3000)]
    offsets = np.cumsum([3] + [len(t) for t in texts])
    data = np.frombuffer(b"xyz" + b"".join(texts) + b"behind", np.uint8)
    assert own.encode_rows(data, offsets) == [own.whole(t) if t else b"" for t in texts]
    assert own.encode_rows(data, offsets[:1]) == []

    asked, tokenize = [], own.tokenize
    own.tokenize = lambda piece: asked.append(piece) or tokenize(piece)
    # more new parts than are remembered come between the same two, and again in every text
    new = [b"x" + bytes(draw.choices(b"abcdefghij", k=9)) for _ in range(2000)]
    text = b" ".join([b"a", *new, b"same%%%"])
    offsets = np.arange(4) * len(text)
    assert own.encode_rows(np.frombuffer(text * 3, np.uint8), offsets) == [own.whole(text)] * 3
    assert len(asked) <= len(set(new)) + 2
