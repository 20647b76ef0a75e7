"""Spelling variants, token counts and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartaspark.llm import merkle, spelling, tokencounts
from cartaspark.llm.queries import BYTE_VOCABULARY, LOWER, UPPER, oracle_sql, queries, vocabulary

DATA = "/root/testdata"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))


PIECES = ["don't", "we'll", "'s", "''s", "it's,", "x'", "\n", "\n\n", " ", "  ", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "a", "Word", "straße", "été", "×", "÷", "12", "3.5", "२", "你好", "\U0001f600", "é", "ƀɏ", "ɐ", "...", "('s", "--", "\x00", "<|endoftext|>", "<|endoftext", "|>", "ſ", "İ", " ", "​", " "]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("tabled", [True, False])
def test_token_counts_of_odd_texts(tabled):
    own, lib = tokencounts.counter(vocabulary(BYTE_VOCABULARY)), tokenizer()
    texts = random_texts(3000, 7) + ["", None, "x" * 100_000, "a b " * 50_000, "\n" * 5000, " '" * 999]
    entries, _, _ = own.cut(pa.array(texts[:1500]))
    words = [w for w in entries.to_pylist() if len(w.encode()) <= tokencounts.LONGEST]
    table = tokencounts.LengthTable(words, own.encode(words)) if tabled else None
    assert own.count(pa.array(texts), table).tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert own.count(pa.array(texts).slice(11, 50), table).tolist() == own.count(pa.array(texts[11:61]), table).tolist()


def test_pre_tokens_are_cut_where_the_tokenizer_cuts():
    own, before = tokencounts.counter(vocabulary(BYTE_VOCABULARY)), tokenizer().pre_tokenizer
    for text in random_texts(500, 8):
        if "<|endoftext|>" not in text:
            entries, which, _ = own.cut(pa.array([text]))
            found = [p for i in which for p in (x[0] for x in before.pre_tokenize_str(entries[int(i)].as_py()))]
            assert found == [x[0] for x in before.pre_tokenize_str(text)]
    entries, which, _ = own.cut(pa.array(["Most words, and 12 numbers, are one pre-token."]))
    assert [entries[int(i)].as_py() for i in which] == ["Most", " words", ",", " and", " 12", " numbers", ",", " are", " one", " pre", "-", "token", "."]


def test_length_table_hits_only_what_it_holds():
    rnd = random.Random(3)
    words = list({"".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 9))) for _ in range(4000)})
    table = tokencounts.LengthTable(words[::2], list(range(len(words[::2]))))
    assert table.lengths(pa.array(words, pa.large_string())).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(words))]
    assert tokencounts.LengthTable([], []).lengths(pa.array(["x"], pa.large_string())).tolist() == [-1]


def test_summaries_keep_every_frequent_entry():
    rnd, counts, true = random.Random(5), {}, {}
    for _ in range(20_000):
        w = f"w{rnd.randint(1, 40)}" if rnd.random() < 0.5 else f"r{rnd.randint(1, 9000)}"
        true[w] = true.get(w, 0) + 1
        counts[w] = counts.get(w, 0) + 1
        if len(counts) > 200:
            counts = tokencounts.shrink(counts, 100)
    assert all(w in counts for w, n in true.items() if n > 20_000 / 100)
    assert all(true[w] - 20_000 / 100 <= n <= true[w] for w, n in counts.items())


def test_token_counts_query(spark, make_docs, monkeypatch):
    texts = [*random_texts(60, 9), None, "", "same", "same"]
    docs = make_docs([(i if i % 9 else None, t) for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit(-1)).repartition(3)
    monkeypatch.setattr(tokencounts, "FAN_IN", 2)
    found = tokencounts.count_tokens(docs, vocabulary(BYTE_VOCABULARY)).collect()
    lib = tokenizer()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((i if i % 9 else None, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)), key=key)
    assert tokencounts.count_tokens(docs.limit(0), vocabulary(BYTE_VOCABULARY)).collect() == []
    plan = tokencounts.count_tokens(docs, vocabulary(BYTE_VOCABULARY), tokencounts.LengthTable([], []))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the test's own repartition


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies_count_whole_texts(name):
    texts = ["A small Example, isn't it?", "", "two\nlines  here"]
    path = vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        expected = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    else:
        from tokenizers import Tokenizer

        expected = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokencounts.counter(path).count(pa.array(texts), None).tolist() == expected


def test_token_counts_of_the_given_table(spark):
    found = {r[0]: tuple(r[1:]) for r in queries()["op12_token_counts"](spark, f"{DATA}/sf0.001").collect()}
    lib, rows = tokenizer(), spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert found == {r[0]: (len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows}


# --- spelling ---------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (n, len(near), -best[0] if forms[w] else None)
    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return sorted((w, forms[w], root(w), *out[w]) for w in counts)


def some_words(seed, n=300):
    rnd, words = random.Random(seed), {}
    bases = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))) for _ in range(n)] + ["prefix" + "".join(rnd.choice("xy") for _ in range(5)) for _ in range(60)]
    for w in bases:
        words[w] = rnd.choice([1, 5, 5, 25, 30, 125, 700])
        at = rnd.randrange(len(w))
        words.setdefault(w[:at] + w[at + 1 :] or "q", rnd.choice([1, 5]))
    words["l" * 3000], words["l" * 3001], words["\U0001f600abc"], words["\U0001f601abc"] = 7, 99, 3, 3
    return words


@pytest.mark.parametrize("area, most", [(1 << 14, 1024), (60, 5)])
def test_variants_against_all_pairs(spark, monkeypatch, area, most):
    monkeypatch.setattr(spelling, "AREA", area)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", most)
    words = some_words(area)
    rows = [*words.items(), (None, 3), ("nothing", None)]
    df = spark.createDataFrame([(w, n, "clash") for w, n in rows], "word string, n long, root string")
    key = lambda r: (r[0], *((x is None, x) for x in r[1:]))
    assert sorted(map(tuple, spelling.variants(df).collect()), key=key) == sorted(brute_variants(words), key=key)


def test_variants_of_small_tables(spark):
    schema = "word string, n long"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([("color", 1), ("color", 1), ("colour", 10), ("", 4), ("a", 20), ("b", 100)], schema)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(twice).collect()}
    assert found == {"color": ("colour", "colour", 2, 1, 10), "colour": (None, "colour", 10, 1, None), "": ("b", "b", 4, 2, 100), "a": ("b", "b", 20, 2, 100), "b": (None, "b", 100, 2, None)}
    with pytest.raises(ValueError):
        spelling.variants(twice, ratio=1)


def test_words_are_counted_and_damaged(spark, make_docs):
    rnd = random.Random(2)
    pool = ["Straße", "Été", "colour", "Colour", "x", "ab×cd", "ő", "don't", "123", "cafés"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(80)] + [None, ""]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    expected = {}
    for key, text in rows:
        for run in spelling.RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] = expected.get(run, 0) + 1
    assert dict(map(tuple, spelling.count_words(make_docs(rows), damage=3).collect())) == expected
    assert spelling.count_words(make_docs(rows).limit(0)).collect() == []


# --- Merkle manifest --------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of each node by level)."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            run = at // 16 * 16
            paths[leaf].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
            places[leaf] = at // 16
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*(enc(r[k]) for k in (0, 1, 2, 3, 4)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(groups[s], subs[s][1], strict=True):
            path = path + top
            own = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(own)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), subs[s][0], root, h(*(x for p in path for x in p)), folded, folded == root))
    return out


def manifest(docs):
    lowered = {"text": F.translate("text", UPPER, LOWER)}
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*(lowered.get(c, F.col(c)) for c in merkle.FIELDS)))
    found = merkle.Manifest(docs, now).proofs()
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), (f := merkle.fold(F.coalesce("now", "leaf"), F.col("path"))), f == F.col("root")).collect()


def record(i, source, text="Text", lang="en", n=4):
    return (i, source, lang, n, text)


def test_blocks_end_where_their_tree_does():
    for size, heights in ((1, 1), (2, 2), (16, 2), (17, 3), (4096, 4), (4097, 4)):
        levels = merkle.levels_of([h(str(i)) for i in range(min(size, 4096))], size)
        assert len(levels) == heights and (len(levels[-1]) == 1 or size == 4097)
    assert [len(x) for x in merkle.levels_of(["a"], 4097)] == [1, 1, 1, 1]


def test_manifest_against_brute_force(spark):
    rows = [record(i, f"size{n}", f"T{i}") for n in (1, 2, 15, 16, 17, 255, 257, 600) for i in range(n)]
    rows += [record(i, None, None if i % 3 else "", None, None) for i in range(20)]
    rows += [record(None, "ids"), record(None, "ids", "other"), record(3, "ids"), record(3, "ids"), record(3, "ids", "x"), record(-4, "ids"), record(2**62, ""), record(5, "é"), record(5, "\U0001f600"), record(5, "￮")]
    rows += [record(7, "copies")] * 300
    rows += [record(i, f"many{i}", "Some TEXT " * 3) for i in range(70)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, manifest(docs)), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_a_source_beyond_one_block(spark):
    rows = [record(i, "big" if i else "small", f"T{i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, manifest(docs))) == sorted(brute_manifest(rows))


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = merkle.Manifest(spark.createDataFrame([], schema))
    assert empty.root() is None and empty.proofs().collect() == []
    one = merkle.Manifest(spark.createDataFrame([record(None, None, None, None, None)], schema))
    (row,) = one.proofs().collect()
    assert row["leaf"] == row["subroot"] == row["root"] == one.root() == h("-", "-", "-", "-", "-") or row["leaf"] == one.root()
    assert row["path"] == []


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    df = queries()[name](spark, f"{DATA}/sf0.001")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]}) q").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))
