import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arborstat.llm import token_files
from arborstat.llm.bpe import encode_decode, encoder
from arborstat.llm.packing import first_fit_decreasing, pack_documents
from arborstat.llm.shared import new_path
from arborstat.llm.tokens import text_ids

from .common import documents, frame, odd_rows, repeated_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def strange(n):
    rng = random.Random(5)
    letters = [*"abcthe'ssrvdl  \t\n\x1c\x85ΣσςİIéÉ漢字한١½①😀ſŉ'  .,!$%", "<|endoftext|>", "<|startoftext|>", "the", "aaaa", "'ll", "  "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(chr(rng.randint(0, 0x2FFF)) for _ in range(12)) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_by_word_is_the_library(path):
    library, mine = Tokenizer.from_file(path), text_ids(path)
    for text in [*strange(1500), *(t for _, t in documents())]:
        assert np.frombuffer(mine.encode_bytes(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefix_encoder_is_the_library():
    library, mine = Tokenizer.from_file(WORD), encoder(WORD)
    for text in [*strange(1500), "a" * 3000, "hashing" * 900, *(t for _, t in documents())]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(mine.encode(text)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("rows", [odd_rows(), repeated_rows(), []])
def test_encode_decode_rows(spark, rows):
    got = encode_decode(frame(spark, rows), WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and key


@pytest.mark.parametrize("rows", [odd_rows(), repeated_rows(), []])
def test_packing(spark, rows):
    got = pack_documents(frame(spark, rows), WORD, capacity=256).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in got) == sorted(
        (str(d), s, min(256, n - s)) for d, t, *_ in rows for n in [len(ids_of(WORD, t)) + 1] for s in range(0, n, 256)
    )
    bins = {}
    for r in got:
        assert r.length <= 256
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    for d, t, *_ in odd_rows():
        ids = np.array([*ids_of(WORD, t), 2], "<u4")
        for r in got:
            if r.doc_id == d:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 333):
        lengths = np.sort(rng.integers(1, 101, n))[::-1]
        room, want = [], []
        for size in lengths:
            k = next((i for i, r in enumerate(room) if r >= size), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= size
        assert list(zip(*map(np.ndarray.tolist, first_fit_decreasing(lengths, 100)), strict=True)) == want


def source_range(source):
    source.seek(0)
    whole = source.read_buffer(source.size())
    return whole.address, whole.address + whole.size


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_token_files_round_trip(spark, rows):
    folder = new_path(spark, "test-ids")
    got = token_files.round_trip(spark, frame(spark, rows), BYTE, folder=folder).collect()
    at, want = 0, []
    for doc, text, *_ in rows:
        ids = np.array([*ids_of(BYTE, text), 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    if rows:
        stream = []
        for path in token_files.sequence_paths(folder):
            import pyarrow as pa

            with pa.memory_map(path) as source:
                held = token_files.SequenceFile(source)
                for k in range(held.sequences):
                    ids, mask = held.get(k)
                    assert len(ids) == len(mask) == token_files.LENGTH and ids.base is not None
                    first, last = source_range(source)  # views into the map, not copies
                    assert first <= ids.ctypes.data < last and first <= mask.buffers()[1].address < last
                    stream += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert stream == [i for _, t, *_ in rows for i in [*ids_of(BYTE, t), 2]]


def test_token_files_with_null_and_repeated_ids(spark):
    got = token_files.round_trip(spark, frame(spark, repeated_rows()), BYTE).collect()
    assert len(got) == len(repeated_rows())
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0


def test_extra_columns_clash(spark):
    """Columns of the input that have the names of results are ignored."""
    df, extra = frame(spark, odd_rows()), ("start", "length", "n_tokens", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group", "part", "file")
    clash = df.selectExpr("*", *(f"'x' as {c}" for c in extra))
    for run in (lambda d: pack_documents(d, WORD, capacity=256), lambda d: encode_decode(d, WORD), lambda d: token_files.round_trip(spark, d, BYTE)):
        plain, odd = run(df), run(clash)
        assert odd.columns == plain.columns and sorted(map(tuple, odd.collect())) == sorted(map(tuple, plain.collect()))


def latin(n):
    """Every letter up to U+024F alone and between others, then texts of them, of which few are split by the library."""
    rng, pool = random.Random(12), [chr(c) for c in range(0x250)]
    marked = "abcABC 'sS12.,\u00e9\u00c9\u00dc\u00fc\u00df\u0130\u0131\u018f\u0307\u0301\u2019\u20ac"
    return [*pool, *(f"a{c}b" for c in pool), "Bak\u0131 \u018fli", *("".join(rng.choice(p) for _ in range(rng.randint(1, 30))) for p in (pool, marked) for _ in range(n))]


def test_latin_letters_are_the_library():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    prefix, words, raw = encoder(WORD), text_ids(WORD), text_ids(BYTE)
    for text in latin(50_000):
        ids = word.encode(text, add_special_tokens=False).ids
        assert prefix.encode(text).tolist() == ids
        assert np.frombuffer(words.encode_bytes(text), "<u4").tolist() == ids
    for text in latin(5_000):
        assert np.frombuffer(raw.encode_bytes(text), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids
