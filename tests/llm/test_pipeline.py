"""The corpus pipeline stage by stage, and registration."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import registry


def word(rng):
    return "".join(rng.choice(("ka", "lo", "mi", "ter", "sun", "val")) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(["the", "of", "and", word(rng), word(rng), word(rng)]) for _ in range(n))
    bench = [plain(30) for _ in range(5)]
    rows = [(i, plain(3000 if 10 <= i < 15 else 120), "en", f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i + 10][1] + " " + word(rng), "en", "s1") for i in range(5)]  # near copies
    rows += [(300 + i, plain(40) + " " + bench[i] + " " + plain(40), "en", "s1") for i in range(5)]  # leaks
    rows += [(None, plain(100), "en", "s0"), (20, rows[20][1], "en", "s0")]  # no id, a repeated row
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "too short", "en", "s0"), (403, "again and again we go " * 30, "en", "s0")]
    rows += [(500 + i, "Home page menu\n" + plain(100), "en", "s2") for i in range(20)]
    at = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept, counts = [], []
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, corpus).cache()
        if k < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS), name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        kept.append(set(ids))
        counts.append(len(ids))
        if name == "line_dedup":
            assert docs.where(F.col("text").contains("Home page menu")).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    clean = {*range(60), *range(500, 520)}
    quality, lines, dedup, leaks, mixed = kept
    assert clean <= quality and not quality & {400, 401, 402, 403}
    assert lines == quality
    assert clean <= dedup and not dedup & set(range(100, 105)) and not dedup & set(range(200, 205))
    assert clean <= leaks and not leaks & set(range(300, 305))
    assert None in leaks and counts[2] == len(dedup)
    assert mixed <= leaks and len(mixed) > 0.6 * len(leaks)


def test_run_and_empty(spark, corpus, tmp_path):
    assert P.run(spark, corpus).count() > 0
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_copies_keep_one_to_the_end(spark, tmp_path):
    """Copies are over 5 % of their source; one of them is left after the last stage, with its lines."""
    rng = random.Random(9)
    plain = lambda n: " ".join(rng.choice(["the", "of", "and", word(rng), word(rng), word(rng)]) for _ in range(n))
    copied = "\n".join(plain(60) for _ in range(3))
    texts = [copied] * 8 + ["Home page menu\n" + plain(150) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, plain(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cleaned_ = P.line_dedup(spark, docs, str(tmp_path)).collect()
    assert all(r["text"] == copied for r in cleaned_ if r["doc_id"] < 8) and not any("Home page menu" in r["text"] for r in cleaned_)
    assert [r["doc_id"] for r in P.run(spark, str(tmp_path)).collect() if r["doc_id"] < 8] == [0]


def test_rows_without_ids_are_judged_by_their_texts(spark):
    """Copies go whether ids are null, repeated or their own; other texts stay, under the same id too."""
    rng = random.Random(3)
    text = [" ".join(word(rng) for _ in range(80)) for _ in range(5)]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[2]), (9, text[4]), (8, text[4]), (None, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string")
    out = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()), key=repr)
    assert out == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4])], key=repr)


def test_null_source_is_a_site(spark):
    """Its boilerplate goes, and not that of the source whose name is empty."""
    rows = [(i, f"Home page menu\nline {i}", None) for i in range(40)] + [(100 + i, f"Home page menu\nline {i}" if i < 2 else f"line {i}", "") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["source"]) for r in P.line_dedup(spark, docs, "").collect()}
    assert out == {i: (t if s is not None else t.split("\n")[1], s) for i, t, s in rows}


def test_registry():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark):
    """Every stage on its own input, the smallest table: SQL for the rules, Python for the rest."""
    import duckdb
    from test_operators import brute_fp, brute_hits, cleaned, filled

    from tessella.llm.lines import LineParams
    from tessella.llm.mix import MixParams
    from tessella.llm.op10_quality import quality_sql

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    items = c.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, ok in c.sql(f"SELECT doc_id, kept FROM ({quality_sql()})").fetchall() if ok}
        elif name == "line_dedup":
            want = cleaned([(i, r["source"], r["text"]) for i, r in before.items()], LineParams(), distinct=True)
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, _, t, _, _ in want}
        elif name == "simhash_dedup":
            fps = {i: brute_fp(r["text"]) for i, r in before.items()}
            label = {i: i for i in fps}
            changed = True
            while changed:
                changed = False
                for i in fps:
                    low = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4)
                    changed, label[i] = changed or low != label[i], low
            assert set(after) == {i for i in fps if label[i] == i} and len(after) < len(before)
            assert all(after[i] == before[i] for i in after)
        elif name == "decontaminate":
            assert set(after) == {i for i, r in before.items() if not brute_hits(r["text"], items, 10)[-1]}
        else:
            sizes = {}
            for r in before.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
            want = filled(sizes, MixParams())
            assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and 0 < r["taken"] <= 3 * r["size"] for r in after.values())
            assert all(r["text"] == before[i]["text"] and r["lang"] == before[i]["lang"] and r["size"] == len(r["text"].split()) for i, r in after.items())
            for s, n in want.items():
                got = sum(r["taken"] for r in after.values() if r["source"] == s)
                assert abs(got - n) <= 2 * MixParams().block + MixParams().tolerance * n
            # the shards that the draws fill: every slot once, and about as many blocks as words are taken
            slots = spark.read.parquet(P.shards_path(spark)).collect()
            assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and max(r["slot"] for r in slots) < MixParams().shard
            assert sum(r["taken"] for r in after.values()) <= MixParams().block * len(slots) <= 1.05 * sum(r["taken"] for r in after.values())


def test_batches_are_bounded_by_bytes(spark):
    """After a stage, Python gets texts by the few megabytes; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        docs = spark.range(64).selectExpr("id AS doc_id", "repeat('word word ', 50000) AS text", "'en' AS lang", "'s' AS source", "500000L AS n_chars").coalesce(1)
        P.decontaminate(spark, docs, "/root/testdata/sf0.001")
        sizes = [r["n"] for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
        assert sum(sizes) > 32_000_000 and max(sizes) < 6_000_000
        spark.conf.set(name, "1000")
        P.decontaminate(spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, old)
