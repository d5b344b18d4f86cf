import os
import zlib

import numpy as np
import pytest
from edge import LONG, ROWS, documents, empty
from millrace.llm import tokenbin as b
from millrace.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3], [2**32 - 1, 0, 7], list(range(70_000)), [50_256] * 1_000])
def test_round_trip(kind, ids):
    ids = np.array(ids, np.uint32)
    lengths = np.array([len(ids) // 2, len(ids) - len(ids) // 2, 0])
    f = b.File(b.write_file(ids, np.array([5, 6, 7]), lengths, block=1_000, kind=kind))
    assert np.array_equal(f.ids(), ids) and f.lengths.tolist() == lengths.tolist() and f.doc_ids.tolist() == [5, 6, 7]
    if len(f.blocks) > 3:
        assert np.array_equal(f.block(3), ids[3_000:4_000])


def test_planes_shrink_repeated_ids():
    ids = np.tile(np.arange(300, dtype=np.uint32), 1_000)
    assert len(b.write_file(ids, np.array([1]), np.array([len(ids)]))) < ids.nbytes / 20
    with pytest.raises(ValueError, match="token file"):
        b.File(b"nothing of the kind" * 3)


TEXTS = ["it's  can't.. 'S don't!!'s x,'ll", " lead", "trail  ", "  x   y", "", "a\tb \n c", "word!!'s a..b 3.5, é, ñ!! 5%% x5,", "a <|endoftext|> b<|endoftext|>,", "日本 語。 ok", " \n\n  a", "x" * 5_000, LONG]


def test_pieces_give_the_tokenizers_ids(tokenizer):
    encode = b.Encoder(tokenizer_path())
    for _ in range(2):  # from the cache, too
        for text, found in zip(TEXTS, encode(TEXTS), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def by_hand(tokenizer, rows):
    at, out = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2_000_000, 50])
def test_query_rows(spark, tokenizer, size):
    rows = [(k * 7 % 101, t, None) for k, t in enumerate(TEXTS * 5)] + ROWS
    files = b.write_tokens(documents(spark, rows).repartition(5), tokenizer_path(), file_ids=size, block=64)
    got = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in b.digest(files).collect()), key=str)
    assert got == by_hand(tokenizer, rows)
    assert size > 100 or files.count() > 8


def test_the_cache_is_bounded_in_bytes(tokenizer, monkeypatch):
    """Texts without blanks don't fill it, whatever their length, and ids stay right when it is emptied."""
    monkeypatch.setattr(b, "CACHE_BYTES", 2_000)
    encode = b.Encoder(tokenizer_path())
    texts = ["語" * 3_000, "QUJD" * 5_000, "a" + "!" * 3_000, *(f"w{k} x{k}" for k in range(50))]
    for text in texts:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert all(len(p) <= b.CACHE_PIECE for cache in (encode._heads, encode._rest) for p in cache) and encode._rest._held < 4_000


def test_order_and_export(spark, tokenizer, tmp_path):
    """Files in another order than that of ids, written as files of their own and read back."""
    rows = [(k, f"text {k}", str(9 - k)) for k in range(10)] + [(None, None, None)]
    files = b.write_tokens(documents(spark, rows), tokenizer_path(), file_ids=7, order=["source"])
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or ""))]
    assert [r["doc_id"] for r in b.digest(files).orderBy("start").collect()] == want
    written = b.export(files, str(tmp_path / "out")).collect()
    found = [b.File(open(r["path"], "rb").read()) for r in sorted(written, key=lambda r: r["path"])]
    assert len(found) == files.count() > 2 and sum(len(f.ids()) for f in found) == sum(len(tokenizer.encode(r[1] or "").ids) + 1 for r in rows)


def test_edges(spark):
    assert b.digest(b.write_tokens(empty(spark), tokenizer_path())).collect() == []
    assert os.path.isfile(tokenizer_path())
