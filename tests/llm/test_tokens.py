import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from keyloom.llm import bpe, packing, token_files
from keyloom.llm.common import pieces, whole

from .conftest import ODD

RANKS = P.path("byte_bpe_50k.tiktoken")


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "b", "T", "é", "É", " ", "  ", "\n", "\t", ".", ",", "'s", "'re", "12", "$", "日", "<|endoftext|>", "<|", "Σ", "İ", " ", "\x1c", "!?", "the", "word", "###", "_", "x\ny", "'", "-", "|", "(Q)"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(16))) for _ in range(n)]


def test_merges_like_the_library():
    own, memo = bpe.coder(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(2)
    texts = random_texts(3000) + ["a" * 1500, "".join(rnd.choice("abcde") for _ in range(5000)), "thatthisthe" * 200]
    for t, ids in zip(texts, memo(pa.array(texts)), strict=True):
        assert "".join(map(whole, pieces(t))) == t
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_round_trip(docs):
    out = bpe.round_trip(docs(ODD), RANKS, P.PATTERN).collect()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(hashlib.sha256((t or "").encode()).hexdigest())
    assert len(out) == len(ODD) and all(r.decoded_sha256 in texts[r.doc_id] for r in out)
    assert bpe.round_trip(docs([]), RANKS, P.PATTERN).count() == 0
    encoded = bpe.encode(docs(ODD), RANKS, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()) == sorted((t or "").encode() for _, t in ODD)


@pytest.mark.parametrize(("name", "width"), [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 4)])
def test_pieces_are_encoded_as_in_whole_texts(name, width):
    own, memo, texts = Tokenizer.from_file(P.path(name)), token_files.library_memo(P.path(name), width, width == 4), random_texts(3000, 4)
    texts += ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|><|startoftext|>x <|END", "a<|endoftext|>\n\n <|endoftext|>"]
    for t, ids in zip(texts, memo(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, f"<u{width}").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, docs, tmp_path):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = token_files.write_tokens(docs(ODD), str(tmp_path / "t"), P.path("word_bpe_49k.json"), 1)
    assert sum(r.n_docs for r in manifest.collect()) == len(ODD)
    start = 0
    want = []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == want
    token_files.write_tokens(docs([]), str(tmp_path / "none"), P.path("word_bpe_49k.json"), 1)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs):
    rnd = random.Random(6)
    rows = [*ODD, (50, "a  <|endoftext|> b"), *[(100 + i, " ".join(rnd.choice(["the", "of", "xyz", "Q1"]) for _ in range(rnd.randrange(1, 2500)))) for i in range(60)]]
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs(rows), P.path("byte_bpe_50k.json")).collect()
    crcs = sorted(zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 5:
            by_doc[r.doc_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    joined = [zlib.crc32(b"".join(bytes(r.ids) for r in sorted(x, key=lambda r: r.start))) for x in by_doc.values()]
    joined += [r.ids_crc32 for r in out if r.doc_id in (None, 5)]
    assert sorted(joined) == crcs
    for x in by_seq.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r.length for r in out) > 0.9 * 1024 * (len(by_seq) - 1)
    assert packing.pack_documents(docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for case in (rng.poisson(30, 1025), np.eye(1, 1025, 700, dtype=int)[0] * 5, np.zeros(1025, dtype=int), rng.integers(0, 2, 1025)):
        histogram = case.copy()
        histogram[0] = 0
        patterns = packing.plan(histogram)
        used = np.zeros(1025, dtype=int)
        for combo, count in patterns:
            assert sum(combo) <= 1024 and count > 0
            for n in combo:
                used[n] += count
        assert (used == histogram).all()
    filled = packing.plan(np.r_[0, rng.poisson(300, 1024)])
    total = sum(sum(c) * n for c, n in filled)
    assert total / (1024 * sum(n for _, n in filled)) > 0.985
