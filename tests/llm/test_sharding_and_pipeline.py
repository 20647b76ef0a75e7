import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartaspark.llm import packing
from cartaspark.llm.queries import language_model, op1_sharding
from cartaspark.llm.sharding import CommitConflict, ShardedTable


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_append_compact_read(spark, tmp_path):
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, fanout=3, first_tier_bytes=2000, keep_versions=100)
    everything = None
    for k in range(7):
        part = spark.range(k * 100, k * 100 + 90, 1, 2).select("id", F.when(F.col("id") % 5 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.lit(None).cast("string").alias("rows"))
        store.append(part)
        everything = part if everything is None else everything.unionByName(part)
    before = store.manifest()
    assert before["version"] == 7 and [r["shards"] for r in before["runs"]] == [1] * 7
    assert rows_of(store.read()) == rows_of(everything)
    after = store.compact()
    assert len(after["runs"]) < 5 and sum(r["rows"] for r in after["runs"]) == 630
    assert rows_of(store.read()) == rows_of(everything)
    assert rows_of(store.read(7)) == rows_of(everything)
    assert store.vacuum() == 0
    assert not store.compact_once()


def test_retired_runs_are_deleted(spark, tmp_path):
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, fanout=2, keep_versions=1)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10))
        store.compact()
    runs = store.manifest()["runs"]
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == sorted(r["run"] for r in runs)
    assert len(list((tmp_path / "t/manifest").glob("*.json"))) == 1
    (tmp_path / "t/data/left-over").mkdir()
    assert store.vacuum() == 1 and store.read().count() == 40


def test_commits_do_not_overwrite(spark, tmp_path):
    store = ShardedTable(spark, f"file://{tmp_path}/data/t")  # a root below a folder of the same name as the store's own
    store.append(spark.range(3))
    with pytest.raises(CommitConflict):
        store._commit(0, spark.range(1).schema.json(), [])
    assert store.version() == 1
    store.append(spark.range(0))
    assert store.version() == 2 and store.read().count() == 3
    with pytest.raises(ValueError):
        ShardedTable(spark, f"file://{tmp_path}/none").read()


def test_nulls_repeats_long_texts_and_nested_columns(spark, make_docs, tmp_path):
    docs = make_docs([(None, None), (1, "a"), (1, "a"), (2, ""), (3, "long " * 100_000)]).withColumn("bytes", F.array(F.struct(F.lit(1).alias("run"))))
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 18, fanout=2)
    for _ in range(3):
        store.append(docs)
        store.compact()
    assert rows_of(store.read()) == sorted(rows_of(docs) * 3)


def test_many_partitions_make_few_shards(spark, tmp_path):
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, keep_versions=1)
    written = 0
    for k in range(8):
        part = spark.range(k * 1000, k * 1000 + 1000, 1, 200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        written += store.append(part)["runs"][-1]["shards"]
        store.compact()
    made = store.manifest()
    size = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert written <= 8 and sum(r["shards"] for r in made["runs"]) <= 4
    assert size < 1_000_000 and store.read().count() == 8000


def test_a_merge_without_gain_ends_compaction(spark, tmp_path, monkeypatch):
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, fanout=2)
    for k in range(3):
        store.append(spark.range(k * 10, k * 10 + 10))
    write = store._write
    monkeypatch.setattr(store, "_write", lambda df: write(df.repartition(8)))
    before = store.version()
    assert store.compact()["version"] == before and store.read().count() == 30


def test_an_arrival_is_read_by_all_tasks_of_its_plan_and_once(spark, tmp_path):
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20)
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        reads.add(1)
        yield from frames

    run = store.append(spark.range(0, 120, 1, 12).mapInPandas(counted, "id long"))["runs"][0]
    assert reads.value == 12 and (run["shards"], run["rows"]) == (1, 120)
    assert [p.name for p in (tmp_path / "t/data").iterdir()] == [run["run"]]


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, fanout=2, keep_versions=1) for _ in range(2))
    one.append(spark.range(0, 10))
    commit = one._commit

    def late(base, schema, runs):
        """The other writer commits first, once."""
        monkeypatch.setattr(one, "_commit", commit)
        two.append(spark.range(10, 20))
        return commit(base, schema, runs)

    monkeypatch.setattr(one, "_commit", late)
    one.append(spark.range(20, 30))
    assert one.version() == 3 and sorted(r.id for r in two.read().collect()) == list(range(30))

    def merged(base, schema, runs):
        monkeypatch.setattr(one, "_commit", commit)
        two.compact()
        return commit(base, schema, runs)

    monkeypatch.setattr(one, "_commit", merged)
    assert not one.compact_once()  # its runs have gone
    assert sorted(r.id for r in one.read().collect()) == list(range(30)) and one.vacuum() == 0


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        store = ShardedTable(spark, f"file://{tmp_path}/t", keep_versions=2)
        for n in range(3):
            store.append(spark.range(100 * k + 10 * n, 100 * k + 10 * n + 10, 1, 1))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    store = ShardedTable(spark, f"file://{tmp_path}/t")
    assert store.version() == 9 and sorted(r.id for r in store.read().collect()) == sorted(100 * k + n for k in range(3) for n in range(30))


def test_tiers_over_many_mixed_arrivals(spark, tmp_path):
    """After every arrival: all rows once, no full tier that a merge would help, each row written no more often than tiers allow."""
    import random

    rng, fanout, first, target = random.Random(4), 3, 4000, 1 << 16
    store = ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=target, fanout=fanout, first_tier_bytes=first, keep_versions=1)
    written, pack = [0], store._pack

    def counting(schema, group, size):
        made = pack(schema, group, size)
        written[0] += made["rows"]
        return made

    store._pack = counting
    total = 0
    for _ in range(40):
        n = rng.choice([0, 1, 20, 60, 300, 1500])
        store.append(spark.range(total, total + n, 1, rng.choice([1, 3])).selectExpr("id", "sha2(string(id), 256) AS text"))
        total += n
        made = store.compact()
        sizes: dict[int, list[dict]] = {}
        for r in made["runs"]:
            if r["bytes"] < r["shards"] * target // 2:
                tier, edge = 0, first
                while r["bytes"] > edge:
                    tier, edge = tier + 1, edge * fanout
                sizes.setdefault(tier, []).append(r)
        assert all(len(v) < fanout or -(-sum(r["bytes"] for r in v) // target) >= sum(r["shards"] for r in v) for v in sizes.values())
        assert sum(r["rows"] for r in made["runs"]) == total
    got = store.read()
    assert got.count() == total and got.select("id").distinct().count() == total
    assert len(made["runs"]) < 20 and written[0] <= 6 * total


def test_tiers_group_similar_sizes(spark):
    store = ShardedTable(spark, "file:///nowhere", target_bytes=1 << 30, fanout=4, first_tier_bytes=100)
    sizes = [50, 80, 100, 10, 150, 390, 399, 450, 1500, 800]
    groups = store.plan([{"run": str(i), "shards": 1, "bytes": b, "rows": 1} for i, b in enumerate(sizes)])
    assert [sorted(r["bytes"] for r in g) for g in groups] == [[10, 50, 80, 100]]


def test_sharding_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text").cast("long"), F.sha2("text", 256))
    got = op1_sharding(spark, sf)
    assert rows_of(got.select("doc_id", F.col("n_chars").alias("length(text)"), F.col("text_sha256"))) == rows_of(want.toDF("doc_id", "length(text)", "text_sha256"))
    assert got.first()["version"] > 8 and got.select("shard").distinct().count() <= 8


def test_pipeline_against_brute_force(spark):
    from test_jaccard import brute_force
    from test_lines_and_copies import brute_lines

    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_model(documents)
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    kept = []
    for i, t in rows:
        lang, score = model.identify(t)
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept.append((i, t))
    kept = [(i, "\n".join(lines)) for i, (lines, _) in brute_lines(kept, 10).items()]
    component = brute_force(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [" ".join(tokens(r[0])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    clean = {i for i, t in kept if not any(f" {item} " in f" {' '.join(tokens(t))} " for item in items)}
    got = corpus_pipeline.run(spark, sf).toPandas()
    ids = set(got["doc_id"])
    assert ids <= clean
    grams = {g for item in items for w in [item.split()] for g in zip(*[w[k:] for k in range(5)], strict=False)}
    for i, t in kept:
        if i in clean - ids:  # dropped for part of an item
            w = tokens(t)
            assert len(grams & set(zip(*[w[k:] for k in range(5)], strict=False))) >= 3
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    encoder = packing.encoder(corpus_pipeline.vocabulary())
    texts = dict(kept)
    lengths = got.groupby("doc_id")["length"].sum()
    assert all(len(encoder.encode(pa.array([texts[i]]))[0]) + 1 == lengths[i] for i in ids)


def test_stages_keep_columns(spark, make_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "the thing was with that and", "en", None, None), (None, None, None, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs.unionByName(odd), sf)
        assert made.schema.names == docs.schema.names and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        assert made.where("doc_id is null").count() >= 1
        assert stage(spark, docs.limit(0), sf).count() == 0
