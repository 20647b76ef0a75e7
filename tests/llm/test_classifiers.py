import random
import zlib

import numpy as np

from cartaspark.llm import langid, quality
from cartaspark.llm.queries import op5_quality_classifier, op6_language_id

LANGUAGES = {"xx": ["ka", "mo", "ti", "re"], "yy": ["sch", "ung", "keit", "be"], "zz": ["eau", "tion", "oi", "é"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_filters(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, text(lang, 40, rng), lang) for i, lang in enumerate(list(LANGUAGES) * 30)]
    train = spark.createDataFrame([*rows, (900, None, "xx"), (901, "lost", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["xx", "yy", "zz"]
    probe = [(1, text("yy", 10, rng).upper()), (2, None), (3, "123 ?!"), (4, ""), (5, "Ka"), (6, text("zz", 30000, rng))]
    got = {r[0]: (r[1], r[2]) for r in langid.identify(make_docs(probe), model).collect()}
    assert [got[i][0] for i in (1, 5, 6)] == ["yy", "xx", "zz"]
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    carried = langid.identify(make_docs(probe), model, carry=True, names=("guess", "sure"))
    assert carried.count() == 6 and "bits" in carried.columns
    assert langid.identify(make_docs([]), model).collect() == []


def test_no_training_rows(spark, make_docs):
    model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(make_docs([(1, "abc")]), model).collect()[0][1:] == ("und", 0.0)


def test_popcounts_are_corrected_for_false_positives():
    rng = np.random.default_rng(0)
    sets = {k: rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for k in ("a", "b")}
    model = langid.LanguageFilters.build(sets)
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    masks = model.table[0][langid._slots(other, model.bits)[0]]
    for at in langid._slots(other, model.bits)[1:]:
        masks = masks & model.table[0][at]
    for k in range(2):
        assert abs(((masks >> k) & 1).mean() - model.fpr[k]) < 0.01


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_quality_classifier(spark, sf).toPandas()
    assert len(got) == 10000 and got["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_quality_edge_cases(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "word " * 50000)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = {r[0]: r[1] for r in quality.score(docs, model).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5}
    assert quality.score(make_docs([]), model).collect() == []
    none = quality.fit(docs, labels.limit(0))
    assert none.prior == 0.5


def test_more_languages_than_a_word_has_bits(spark, make_docs):
    rng = random.Random(4)
    stems = {f"l{i:02d}": [chr(0x4E00 + 20 * i + j) + chr(0x4E00 + 20 * i + (j * 7) % 20) for j in range(20)] for i in range(70)}
    rows = [(100 * k + j, " ".join(rng.choices(stems[lang], k=30)), lang) for k, lang in enumerate(stems) for j in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70 and model.table.shape[0] == 2
    probe = [(k, " ".join(rng.choices(words, k=8))) for k, words in enumerate(stems.values())]
    got = {r[0]: r[1] for r in langid.identify(make_docs(probe), model).collect()}
    assert [got[k] for k in range(70)] == list(stems)


def test_language_by_brute_force_and_ties(spark, make_docs):
    """Filters agree with exact sets of n-grams but for false positives; of equal counts the first name wins."""
    rng = random.Random(5)
    sets = {k: np.unique(np.concatenate([langid.grams(text(k, 200, rng)) for _ in range(3)])) for k in LANGUAGES}
    model = langid.LanguageFilters.build(sets)
    for k in LANGUAGES:
        for _ in range(30):
            probe = text(k, rng.randrange(1, 60), rng)
            found = langid.grams(probe)
            exact = {n: np.isin(found, own).sum() for n, own in sets.items()}
            name, score = model.identify(probe)
            assert exact[name] >= max(exact.values()) - 0.1 * len(found)
            assert abs(score - exact[name] / len(found)) < 0.1
    same = langid.LanguageFilters.build({"b": sets["xx"], "a": sets["xx"]})
    assert same.identify(text("xx", 20, rng))[0] == "a"
    docs = make_docs([(7, "ka mo"), (7, "sch ung"), (None, "ka mo")])
    assert sorted((r[0] or 0, r[1]) for r in langid.identify(docs, model).collect()) == [(0, "xx"), (7, "xx"), (7, "yy")]


def test_dictionaries_see_the_ends_of_long_texts(spark, make_docs):
    data = b"".join(bytes([i]) * quality.BLOCK for i in range(200))
    drawn = quality.spread_blocks(data, 7)
    assert len(drawn) == 7 and drawn[0][0] == 0 and drawn[-1][0] == 199 and quality.spread_blocks(b"ab", 7) == [b"ab"]
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    good, bad = [noise(3) for _ in range(30)], [noise(3) for _ in range(30)]
    make = lambda i, pool: noise(3000) + " ".join(rng.choices(pool, k=400))
    rows = [(i, make(i, good if i % 2 else bad)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, label int")
    model = quality.fit(make_docs(rows), labels)
    probe = make_docs([(1, " ".join(rng.choices(good, k=100))), (2, " ".join(rng.choices(bad, k=100))), (2, " ".join(rng.choices(good, k=100)))])
    got = sorted((r[0], r[1] > 0.5) for r in quality.score(probe, model).collect())
    assert got == [(1, True), (2, False), (2, True)]


def test_score_equals_plain_compression(spark, make_docs):
    """Brute force: the size difference and the curve, written out."""
    import zstandard

    model = quality.CompressionModel(b"alpha beta gamma delta " * 40, b"one two three four five " * 40, 9.0, 0.2, 0.5)
    texts = ["alpha gamma " * 300, "two five three " * 5, "x", "é" * 3000]
    want = []
    for t in texts:
        size = []
        for d in (model.good, model.bad):
            way = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(sum(len(way.compress(t.encode()[i : i + 1024])) for i in range(0, len(t.encode()), 1024)))
        want.append(1 / (1 + np.exp(-(9.0 * (size[1] - size[0]) / len(t.encode()) + 0.2))))
    got = {r[0]: r[1] for r in quality.score(make_docs(list(enumerate(texts))), model).collect()}
    assert np.allclose([got[i] for i in range(4)], want, atol=0.02)
