import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from keyloom.llm import secrets, token_files  # noqa: E402

from .test_native import plain_dedup, plain_spans  # noqa: E402
from .test_text_sets import plain_classes  # noqa: E402


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents of clean text, junk, near and exact copies, shared passages and secrets."""
    rnd = random.Random(9)
    bank = [f"{a}{b}{c}" for a in "blmnprst" for b in "aeiou" for c in "blmnprst"]
    clean = lambda n: "\n".join(" ".join(rnd.choice(bank) for _ in range(12)) + "." for _ in range(n))
    passage, base = clean(10), clean(12)
    rows = [(i, clean(8)) for i in range(40)]
    rows += [(50 + i, base.replace("b", "B", i)) for i in range(4)] + [(60, rows[3][1]), (61, clean(2) + "\n" + passage), (62, clean(3) + "\n" + passage + "\n" + clean(2))]
    rows += [(70, clean(4) + "\ntoken = abcdef1234567890xyz"), (71, "few words"), (72, " ".join(["a b c d e"] * 20))] + [(80 + i, " ".join("#$%" + rnd.choice(bank) for _ in range(80))) for i in range(5)]
    base_dir = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base_dir}/documents.parquet")
    spark.createDataFrame([(i, int(i < 71), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{base_dir}/labels.parquet")
    return str(base_dir), dict(rows)


def test_stages_against_plain_versions(spark, sf):
    sf_dir, rows = sf
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, texts = docs.columns, rows
    for (name, stage), kind in zip(corpus_pipeline.STAGES[:-1], "QLJS", strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        got = {r.doc_id: r.text for r in out.collect()}
        assert all(r.n_chars == len(r.text) for r in out.collect())
        if kind == "Q":
            assert not {71, 72} & set(got) and set(range(71)) & set(texts) <= set(got) and all(got[i] == texts[i] for i in got)
            assert sum(80 <= i < 85 for i in got) <= 1
        elif kind == "L":
            plain = plain_dedup(texts)
            assert got == {i: t for i, t in plain.items() if t.split()} and 60 not in got and len(got[62]) < len(texts[62]) - 300
        elif kind == "J":
            classes = plain_classes(list(texts.items()), 5, 80)
            assert got == {i: texts[i] for i in texts if (str(i), str(i)) in {(a, c) for a, _, c in classes}}
        else:
            assert got[70].endswith("\n[assign]") and all(not plain_spans(t) for t in got.values())
            assert all(got[i] == texts[i] for i in texts if not plain_spans(texts[i]))
        texts, docs = got, out
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    own = token_files.open_tokenizer(P.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in mine)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, out))


def test_empty_corpus(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert secrets.RULES
