import random
import re

import numpy as np

from keyloom.llm import language, quality

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_plain_ones():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "b ", "c\n", "é#", "|", "\x1c", "\x0b", "日 ", "  ", "a b c d e "]) for _ in range(rnd.randrange(40)))
        assert tuple(map(int, quality.statistics(text)[:5])) == plain(text), text


def good(rnd):
    return " ".join(rnd.choice("the of and reads well here plain words make sense today".split()) + ("." if rnd.random() < 0.1 else "") for _ in range(rnd.randrange(60, 200))) + " z%d" % rnd.randrange(10**6)


def junk(rnd):
    return " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 5) + rnd.choice(["###", "$$$", "%%%"]) for _ in range(rnd.randrange(60, 200)))


def unique_words(text):
    return " ".join(f"{w}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i, w in enumerate(text.split()))


def test_forest_keeps_good_and_rejects_junk(spark, docs):
    rnd = random.Random(2)
    rows = [(i, unique_words(good(rnd)) if i % 6 else unique_words(junk(rnd))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)] + [(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs(rows), labels).collect()}
    kept = [i for i, _ in rows if out[i].kept]
    assert sum(i % 6 != 0 for i in kept) >= 0.97 * 500 and sum(i % 6 == 0 for i in kept) <= 10
    left = quality.keep_good(docs(rows), labels)
    assert sorted(r.doc_id for r in left.collect()) == kept and left.columns == docs([]).columns


def test_doubled_lines_are_anomalous(spark, docs):
    rnd = random.Random(5)
    # short lines that come again between unlike ones: no window of five words is found twice
    lines = lambda text, again: "\n".join(x for w in zip(*[iter(unique_words(text).split())] * 6, strict=False) for x in (" ".join(w), again or "".join(rnd.choices("abcdefgh", k=4)) + " " + "".join(rnd.choices("abcdefgh", k=2))))
    rows = [(i, lines(good(rnd), None if i % 6 else "read on")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs(rows), labels).collect()}
    assert not any(r.base_failed for r in out.values()) and sum(out[i].kept for i, _ in rows if i % 6) >= 0.97 * 500
    assert sum(out[i].kept for i, _ in rows if i % 6 == 0) <= 10


def test_thresholds_come_from_all_labelled_rows(spark, docs):
    rnd = random.Random(8)
    rows = [(i, unique_words(" ".join(rnd.choices("plain words make sense today".split(), k=rnd.randrange(12, 40)))) + "!" * rnd.randrange(4)) for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    table = docs(rows)
    x = np.array([quality.statistics(t) for _, t in rows])
    for f, g in zip(quality.fit(table, labels), quality.GROUPS, strict=True):
        assert f.threshold == np.quantile(f.score(x[:, g]), 1 - quality.SPARE, method="higher")


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXACT", 5)
    monkeypatch.setattr(quality, "BINS", 7)
    rnd = random.Random(4)
    values = [rnd.choice([0.5, rnd.random(), 0.5 + rnd.random() / 1e9]) for _ in range(500)]
    table = spark.createDataFrame([(v,) for v in values], "s double")
    for k in (0, 1, 166, 250, 333, 498, 499):
        assert quality.ranked(table, "s", k) == sorted(values)[k]


def test_odd_rows_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs(ODD), none).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert quality.judge(docs([]), none).count() == 0 and quality.keep_good(docs([]), none).count() == 0


def test_scores_match_plain_path_lengths():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    f = quality.Forest.fit(x, trees=20, rows=64)

    def expected(n):  # mean depth of an unsuccessful search in a tree of n rows
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0

    for row in rng.normal(size=(25, 3)) * 2:
        paths = []
        for t in range(20):
            node, steps = 0, 0
            while f.feature[t, node] >= 0:
                node, steps = 2 * node + 1 + int(row[f.feature[t, node]] >= f.place[t, node]), steps + 1
            assert steps <= f.path[t, node] <= steps + expected(64)
            paths.append(f.path[t, node])
        assert abs(f.score(row[None])[0] - 2 ** -(np.mean(paths) / expected(64))) < 1e-12


def test_shallow_paths_are_anomalous():
    x = np.random.default_rng(1).normal(size=(500, 2))
    f = quality.Forest.fit(x)
    assert f.score(np.array([[9.0, 9.0]]))[0] > f.score(x).max() - 0.05 > f.score(np.array([[0.0, 0.0]]))[0]


SYLLABLES = {"xa": "ka lo mi tu".split(), "xb": "strk brz glim fror".split(), "xc": "éa oué içe aux".split()}


def test_held_out_accuracy(docs):
    rnd = random.Random(3)
    rows, lang = [], []
    for i in range(400):
        own = rnd.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[own]) for _ in range(rnd.randrange(1, 4))) for _ in range(30))))
        lang.append(own)
    table = docs(rows, lang)
    learned = language.learn(table.where(~language.held_out()))
    out = {r.doc_id: r for r in language.classify(table.select("doc_id", "text"), learned).collect()}
    test = [r.doc_id for r in table.where(language.held_out()).collect()]
    assert 40 < len(test) < 120 and np.mean([out[i].lang_pred == lang[i] for i in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_copies_leave_no_language_out(docs):
    rows = [(i, f"kalo mitu text {i % 5}") for i in range(4000)] + [(5000 + i, f"strk brz glim {i}") for i in range(40)]
    learned = language.learn(docs(rows, ["xa"] * 4000 + ["xb"] * 40))
    assert list(learned) == ["xa", "xb"] and all(f"kalo mitu text {i}" in learned["xa"].decode() for i in range(5))


def test_no_letters_is_unknown(docs):
    learned = {"xa": b"some text here", "xb": b"other words"}
    out = language.classify(docs([(1, None), (2, "12 !! ½"), (3, "word"), (3, "word")]), learned).collect()
    assert sorted((r.doc_id, r.lang_pred == "und") for r in out) == [(1, True), (2, True), (3, False), (3, False)]
    assert language.learn(docs([])) == {} and language.classify(docs([(1, "x")]), {}).first().lang_pred == "und"


def test_dictionaries_come_from_all_over_long_texts(docs):
    rows = [(i, "start " * 3000 + f"middle{i} " * 3000 + "finish " * 3000) for i in range(5)] + [(9, "short text")]
    own = language.learn(docs(rows, ["xa"] * 6))["xa"].decode()
    assert all(w in own for w in ("start", "middle3", "finish", "short text")) and len(own) <= language.DICTIONARY


def test_smallest_size_wins(docs):
    import zstandard

    rnd = random.Random(6)
    learned = {k: " ".join("".join(rnd.choice(v) for _ in range(3)) for _ in range(900)).encode() for k, v in SYLLABLES.items()}
    texts = [(i, " ".join("".join(rnd.choice(SYLLABLES[rnd.choice(list(SYLLABLES))]) for _ in range(2)) for _ in range(rnd.choice([1, 5, 40, 900])))) for i in range(60)]
    out = {r.doc_id: r for r in language.classify(docs(texts), learned).collect()}
    for i, t in texts:
        raw, size = t.lower().encode(), {}
        for lang, own in learned.items():
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            size[lang] = sum(len(coder.compress(raw[a : a + language.BLOCK])) for a in range(0, len(raw), language.BLOCK))
        best = min(size.values())
        assert size[out[i].lang_pred] == best
        over = sorted(x / best - 1 for x in size.values())
        assert out[i].rejected == (over[1] < language.MARGIN) and abs(out[i].score - 1 / sum(np.exp(-x / language.MARGIN) for x in over)) < 1e-9
