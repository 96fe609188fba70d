"""Every operator against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chains, crf, decontaminate, hmm, licenses, lines, mix, quality, revisits, simhash, tokens
from tessella.llm.common import Scratch, components, crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, w long, h string, row string, key int, fp long, size string, `order` string, at long, host string, bad string, rid string, `a.b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "the and of river stone light paper garden Über naïve señor winter amber cloud %%% the, and. 12 a".split()


def rows():
    """Documents with every awkward case."""
    rng = random.Random(3)
    out = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", None, None, 7),
        (4, "word", "en", None, 4),
        (5, "one two three", None, "b", 13),
        (6, "a b c d e f g a b c d e f g a b c d e\nsame line\n same line \nsame line\n\n", "en", "b", 60),
        (6, "a b c d e f g a b c d e f g a b c d e\nsame line\n same line \nsame line\n\n", "en", "b", 60),
        (None, "a document without an id, short", "en", "b", 31),
        (7, " ".join(rng.choice(VOCAB) for _ in range(60_000)), "en", "a", 300_000),
        (8, "x" * 100_000, "fr", "a", 100_000),
        (9, "no-space " * 3 + "Ünïcödé ☃ \U0001f600 \x00 end", "fr", "c", 40),
    ]
    for i in range(10, 60):
        n = rng.choice((3, 12, 40, 200))
        text = " ".join(rng.choice(VOCAB) for _ in range(n))
        if i % 3 == 0:
            text = "Menu of this site\n" + text + "\nAll rights"
        out.append((i, text, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "c", None)), len(text)))
    out.append((60, out[20][1] + " extra", "en", "a", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("x", 1, "y", "z", 1, 5, "s", "o", 3, "q", "r", "i", "dot")
    return spark.createDataFrame([(*r, *extra) for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- quality rules


def base(text):
    text = text or ""
    w = WORD.findall(text)
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for j in range(5)}
    ln = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ln) - len(set(ln)), len(hit), failed


def test_quality_measures(docs):
    out = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(out) == sorted(((r[0], *base(r[1])) for r in rows()), key=repr)


def test_quality_verdict(spark):
    rng = random.Random(1)
    plain = [(i, " ".join(rng.choice("the of and to in stream valley copper lantern meadow harbor silent".split()) for _ in range(120)), "en") for i in range(80)]
    noisy = [(100 + i, " ".join(rng.choice(["ab%%%", "cd***", "ef$$$", "gh&&&", "ij|||"]) for _ in range(120)), "en") for i in range(4)]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(plain + noisy, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i, _, _ in plain) and not any(out[i] for i, _, _ in noisy)


def test_quality_references(spark, docs):
    """Common words and classes of every language, with the prior, from plain counts; long words and rare languages included."""
    p = quality.QualityParams(prior_words=50, prior_chars=80, common_share=0.02)
    long = [(900 + i, "extraordinarily long " * 40 + "Ünïcödé", "long", "a", 9) for i in range(2)] + [(950, "one", "rare", "a", 3)]
    every = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([r[:3] for r in long], "doc_id long, text string, lang string"))
    scratch = Scratch(spark, "test")
    got = {r["key"]: r for r in quality.references(scratch.write(quality.word_counts(every)), scratch, p).collect()}
    counts, chars = {}, {}
    for _, text, lang, _, _ in rows() + long:
        for w in WORD.findall(text or ""):
            key = "\x00" if lang is None else lang
            counts.setdefault(key, Counter())[w.lower()] += 1
            k = [sum(c in s for c in w) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-", "!?@[]\\^_`{}~+=/", quality.SYMBOLS)]
            k.append(sum(ord(c) >= 128 for c in w))
            chars[key] = chars.get(key, 0) + np.array([len(w) - sum(k), *k])
    pool, total = sum(counts.values(), Counter()), sum(chars.values())
    assert set(got) == set(counts) and {"long", "rare"} <= set(got)
    for key, c in counts.items():
        n, m = sum(c.values()), sum(pool.values())
        want = {w: (c[w] + 50 * pool[w] / m) / (n + 50) for w in pool}
        want = {w: x for w, x in want.items() if x >= 0.02}
        assert {x["word"]: round(x["share"], 9) for x in got[key]["common"]} == {w: round(x, 9) for w, x in want.items()}
        assert np.allclose(got[key]["ref_classes"], (chars[key] + 80 * total / total.sum()) / (chars[key].sum() + 80))
    assert "extraordinarily" in {x["word"] for x in got["long"]["common"]}


def test_quality_of_a_rare_language(spark):
    """A language of one text is held against the others' words too: prose passes, noise doesn't."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of and to in stream valley copper lantern meadow".split()) for _ in range(n))
    rows_ = [(i, prose(120), "en") for i in range(60)] + [(100, prose(70), "xx"), (101, " ".join(rng.choice(["a%b", "c*d", "e|f", "g$h"]) + str(i) for i in range(70)), "yy")]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(60)) and out[100] and not out[101]


def test_quality_shuffled_reference_agrees(docs):
    wide, narrow = (collected(quality.judged(docs, broadcast_bytes=b).drop("row")) for b in (1 << 25, 0))
    assert wide == narrow


def test_quality_empty(empty):
    assert quality.judged(empty).count() == 0


# --- line dedup


def cleaned(pages, p, distinct=False):
    """pages: (id, host, text); with ``distinct`` each text of a host counts once"""
    trim = lambda x: x.strip(" \t\x0b\x0c\r")
    seen, total = Counter(), Counter()
    for host, text in {(h, t) for _, h, t in pages} if distinct else [(h, t) for _, h, t in pages]:
        if host is not None:
            total[host] += 1
            seen.update({(host, trim(x)) for x in (text or "").split("\n") if trim(x)} if text is not None else ())


    def lower(n, pages):
        """Wilson's lower bound of a share."""
        x, q = n / pages, p.z * p.z / pages
        return (x + q / 2 - math.sqrt(q * x * (1 - x) + q * q / 4)) / (1 + q)

    bad = {k for k, n in seen.items() if n >= 2 and lower(n, total[k[0]]) > p.max_ratio + 1e-12}
    out = []
    for i, host, text in pages:
        if text is None:
            out.append((i, host, None, 0, 0))
            continue
        every = text.split("\n")
        kept = [x for x in every if not (trim(x) and (host, trim(x)) in bad)]
        out.append((i, host, "\n".join(kept), sum(bool(trim(x)) for x in every), len(every) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "z"), [(1 << 25, 1.645), (0, 1.645), (1 << 25, 0.0)])
def test_lines(docs, limit, z):
    p = lines.LineParams(max_ratio=0.1, z=z)
    sites = docs.select("doc_id", F.col("source").alias("host"), "text")
    out = collected(lines.clean(sites, p, limit).select("doc_id", "host", "text", "n_lines", "n_dropped"))
    assert out == cleaned([(r[0], r[3], r[1]) for r in rows()], p)
    assert any(r[4] for r in out)


def test_lines_of_small_sites(spark):
    """Two of two and of ten pages are enough, two of fifteen aren't, one of one never is."""
    pages = [(f"h{n}", "menu\nown" + str(i) if i < 2 else f"own{i}") for n in (1, 2, 10, 15) for i in range(n)]
    out = lines.clean(spark.createDataFrame(pages, "host string, text string")).where("n_dropped > 0").groupBy("host").count().collect()
    assert {(r["host"], r["count"]) for r in out} == {("h2", 2), ("h10", 2)}


def test_page_text(spark):
    from tessella.llm.op2_lines import page_host, page_text

    cases = [(None, None), ("", ""), ("no url", "plain"), ("HTTP://Ex.org:80/x", "<p>a</p><script>x<y</script><b>c"), ("http://u", "<!-- open <p>x"), ("//a/b", "<div>&lt;p&gt; &amp;nbsp;</div>\n\n<br/>z"), ("ftp://h?q", "a < b")]
    got = [tuple(r) for r in spark.createDataFrame(cases, "u string, h string").select(page_host(F.col("u")), page_text(F.col("h"))).collect()]
    assert got == [(None, None), (None, ""), (None, "plain"), ("ex.org", "a\nc"), ("u", "<!-- open \nx"), (None, "<p> &nbsp;\nz"), ("h", "a < b")]


def test_lines_empty(empty):
    assert lines.clean(empty.select("doc_id", "host", "text")).count() == 0


# --- mixing


def filled(sizes, p):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > p.repeats * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(p.repeats * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(docs):
    p = mix.MixParams(block=16, shard=8, bucket_rows=5, group_shards=4)
    out = mix.taken(mix.plan(docs, p)).toPandas()
    want = sorted((-1 if r[0] is None else r[0], len(WORD.findall(r[1] or ""))) for r in rows())
    out["doc_id"] = out["doc_id"].fillna(-1).astype(int)
    assert sorted(zip(out["doc_id"].tolist(), out["size"].tolist(), strict=True)) == want
    assert out.loc[out["doc_id"] == -1, "taken"].sum() > 0
    assert (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), ss=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    sizes = {None if pd.isna(k) else k: v for k, v in by["size"].items()}
    expected = filled(sizes, p)
    assert by["size"].equals(by["ss"])
    for k, r in by.iterrows():
        assert math.isclose(r["target"], expected[None if pd.isna(k) else k], rel_tol=1e-9)
        assert abs(r["taken"] - r["target"]) <= 2 * p.block + 0.02 * r["target"]
    again = mix.taken(mix.plan(docs.repartition(7), p)).toPandas()
    again["doc_id"] = again["doc_id"].fillna(-1).astype(int)
    cols = ["doc_id", "size", "taken"]
    assert out[cols].sort_values(cols).reset_index(drop=True).equals(again[cols].sort_values(cols).reset_index(drop=True))


def drawn_slots(sources, p, rng=np.random.default_rng):
    """{order: slots} from every shard's own draw: what is beyond the bounds goes to those short of theirs, then to those with room."""
    sources = sorted((s for s in sources if s["slots"] > 0), key=lambda s: s["order"])
    want = [s["slots"] for s in sources]
    total, n = sum(want), [0] * len(want)
    for shard in range(-(-total // p.shard)):
        for i, c in enumerate(rng([p.seed, shard]).multinomial(min(p.shard, total - shard * p.shard), np.array(want) / total)):
            n[i] += int(c)
    low = [math.ceil(w * (1 - p.tolerance)) for w in want]
    high = [max(w, min(p.repeats * s["blocks"], math.floor(w * (1 + p.tolerance)))) for w, s in zip(want, sources, strict=True)]
    out = [min(max(x, lo), hi) for x, lo, hi in zip(n, low, high, strict=True)]
    for i in range(len(out)):
        over = sum(out) - total
        out[i] = max(low[i], out[i] - over) if over > 0 else min(high[i], out[i] - over)
    assert sum(out) == total
    return {s["order"]: x for s, x in zip(sources, out, strict=True)}, n


@pytest.mark.parametrize("tolerance", [0.01, 1.0])
def test_mix_takes_what_the_draws_say(docs, tolerance):
    """Words of every row, from the counts that the shards draw and the blocks that the sources' permutations name."""
    p = mix.MixParams(block=16, shard=8, bucket_rows=5, group_shards=4, tolerance=tolerance)
    m = mix.plan(docs, p)
    out = mix.taken(m, places=True).collect()
    order = {r["source"]: r for r in m.sources.collect()}
    slots, drawn = drawn_slots(order.values(), p)
    at = {}
    for r in m.docs.where("size > 0").collect():
        at.setdefault(r["order"], []).append((r["at"], r["size"], r["doc_id"]))
    want = Counter()
    for s in order.values():
        stream = sorted(at.get(s["order"], []), key=lambda x: x[0])
        assert [x[0] for x in stream] == [sum(y[1] for y in stream[:i]) for i in range(len(stream))]
        owner = [i for i, x in enumerate(stream) for _ in range(x[1])]
        words = Counter()
        for k in range(slots.get(s["order"], 0)):
            epoch = k // s["blocks"]
            b = int(mix.permuted(np.array([k % s["blocks"]]), s["blocks"], hash((p.seed, s["order"], epoch)))[0])
            words.update(owner[b * p.block : (b + 1) * p.block])
        want.update((repr(x[2]), x[1], words[i]) for i, x in enumerate(stream))
    assert Counter((repr(r["doc_id"]), r["size"], r["taken"]) for r in out if r["size"]) == want
    assert sum(slots.values()) > 100
    if tolerance == 1.0:  # chance is left alone, but for the limit of repeats
        assert all(x == d or x < d and x >= 3 * s["blocks"] or x > d for (o, x), d in zip(slots.items(), drawn, strict=True) for s in order.values() if s["order"] == o)
        assert any(slots.get(s["order"], 0) != s["slots"] for s in order.values())
    # slots of a shard are its own, and the stretches of a slot fill its block
    table_of = [(r["shard"], r["slot"]) for r in m.slots.collect()]
    assert len(set(table_of)) == len(table_of) == sum(slots.values()) and all(0 <= s < p.shard for _, s in table_of)
    filled_ = Counter()
    for r in out:
        assert sum(x["words"] for x in r["slots"] or []) == r["taken"]
        for x in r["slots"] or []:
            filled_[x["shard"], x["slot"]] += x["words"]
            assert 0 <= x["from"] and x["from"] + x["words"] <= p.block
    assert set(filled_) == set(table_of) and max(filled_.values()) == p.block


def test_other_draws_give_another_mix(docs, monkeypatch):
    p = mix.MixParams(block=16, shard=8, bucket_rows=5, group_shards=4)
    of = lambda q: sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in mix.taken(mix.plan(docs, q)).collect())
    one = of(p)
    monkeypatch.setattr(mix, "multinomial", lambda rng, n, share: np.eye(len(share), dtype=np.int64)[0] * n)
    assert of(p) != one


def test_mix_of_one_id(spark):
    """Null and repeated ids with texts of one size are spread over the buckets."""
    rows = [(None if i % 2 else 5, f"a{i} b c", "s") for i in range(4000)]
    m = mix.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), mix.MixParams(bucket_rows=100))
    assert m.docs.select("at").distinct().count() == 4000
    assert m.docs.groupBy(F.pmod(F.xxhash64("h", "size"), F.lit(40))).count().agg(F.max("count")).first()[0] < 200


def test_mix_targets_saturate(spark):
    sizes = {"a": 10, "b": 500, "c": 3, "d": 0, None: 90}
    got = {r["source"]: r["target"] for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = filled(sizes, mix.MixParams())
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in sizes)


def test_mix_empty(empty):
    assert mix.taken(mix.plan(empty)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    for key in (1, 99):
        assert sorted(mix.permuted(np.arange(n), n, key).tolist()) == list(range(n))


# --- revisits


def test_revisits(spark):
    rng = random.Random(5)
    urls = ["http://A.example/x?b=2&a=1&utm_source=q#f", "https://a.example:443/x?a=1&b=2", "http://a.example/y/", "http://a.example/y.html", None, "bad url"]
    recs = []
    for i in range(400):
        kind = rng.choice(("response", "revisit"))
        recs.append((i if i % 50 else None, rng.choice(urls), rng.choice([None, *range(60)]), kind, rng.choice((None, "e1", 'W/"e1"', '"e1"')), rng.choice((None, "m1", "m2")), rng.choice((None, "d1")), {"date": str(i), "vary": "v", "content-type": "t"} if i % 5 else None))
    recs += [*recs[:20], (900, urls[0], 5, "metadata", None, None, None, None)]
    df = spark.createDataFrame(recs, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>").withColumn("part", F.lit(1)).withColumn("slice", F.lit("x"))
    canon = dict(df.select("url", revisits.canonical_url(F.col("url"))).distinct().collect())
    assert canon[urls[0]] == canon[urls[1]] == "a.example/x?a=1&b=2" and canon[urls[2]] == canon[urls[3]] == "a.example/y"
    bare = lambda e: e and e.removeprefix("W/")

    def expected(r):
        past = [q for q in recs if q[3] == "response" and r[1] is not None and q[1] is not None and canon[q[1]] == canon[r[1]] and r[2] is not None and q[2] is not None and q[2] < r[2]]
        top = max(past, key=lambda q: (q[2], -1 if q[0] is None else q[0]), default=None)
        if top is None:
            return None, "unresolved", None
        pairs = [(bare(r[4]), bare(top[4])), (r[5], top[5]), (r[6], top[6])]
        same = next((x == y for x, y in pairs if x is not None and y is not None), None)
        state = "unchecked" if same is None else "resolved" if same else "mismatch"
        merged = (top[7] or {}) | {h: x for h, x in (r[7] or {}).items() if h in revisits.PERMITTED}
        return top[0], state, None if state == "mismatch" else merged

    want = Counter(repr((r[0], *expected(r)[:2], sorted((expected(r)[2] or {}).items()))) for r in recs if r[3] == "revisit")
    assert {expected(r)[1] for r in recs if r[3] == "revisit"} == {"resolved", "unchecked", "mismatch", "unresolved"}
    for hot, slices in ((3, 1000), (10, 4), (1000, 1000)):
        got = revisits.resolve(df, hot_rows=hot, slices=slices, broadcast_bytes=0 if hot == 10 else 1 << 25).collect()
        assert Counter(repr((r["record_id"], r["refers_to"], r["state"], sorted((r["headers"] or {}).items()))) for r in got) == want
    assert revisits.resolve(df.limit(0)).count() == 0


# --- simhash


def brute_fp(text):
    w = WORD.findall(low(text))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = np.zeros(64, int)
    for s in sh:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        ones += np.array([h >> i & 1 for i in range(64)])
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(sh))


def test_fingerprints(docs):
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(docs).collect()), key=repr)
    assert got == sorted(((r[0], brute_fp(r[1])) for r in rows()), key=repr)


def near_fingerprints():
    """Clusters of different densities, chains of links, and strangers."""
    rng = random.Random(9)
    out = {0, 1, (1 << 64) - 1}
    for size, flips in ((40, 2), (25, 4), (12, 5)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum({1 << rng.randrange(64) for _ in range(flips)}))
    x = rng.getrandbits(64)
    for _ in range(20):
        out.add(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    out |= {rng.getrandbits(64) for _ in range(60)}
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(fps, radius):
    """Smallest position reachable, of each fingerprint, by all pairs."""
    label = list(range(len(fps)))
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


@pytest.mark.parametrize(("radius", "segments", "dense"), [(4, None, 4096), (4, 2, 4096), (4, 3, 4096), (4, 5, 4096), (4, 3, 4), (4, 4, 10), (3, None, 4096), (3, 2, 5), (3, 3, 8), (1, 1, 4), (0, None, 4096), (5, 4, 4096)])
def test_links(spark, radius, segments, dense):
    fps = near_fingerprints()
    reps = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    scratch = Scratch(spark, "test")
    got = dict(components(simhash.links(reps, scratch, radius, segments, dense), scratch).collect())
    label = linked(fps, radius)
    assert [got.get(i, i) for i in range(len(fps))] == label
    assert radius < 3 or len(set(label)) < len(fps) - 30


def test_segments():
    """The first part always has a ball to enumerate, and the rows of a fingerprint stay few at any size."""
    for n in (1, 10**4, 10**6, 10**8, 10**10):
        parts = simhash.plan_segments(simhash.segments_for(n, 4), 4)
        assert max(r for _, _, r in parts) >= 1
        if n <= 10**8:
            assert sum(1 + len(simhash._ball(b, r)) / 2 for _, b, r in parts if r >= 0) < 30


def test_gathered_groups_are_bounded(spark, monkeypatch):
    """A crowded key visits a neighbour with one member, and others with none: neither becomes a gathered group."""
    rng = random.Random(12)
    top = 0b1011
    crowd = {(rng.getrandbits(48) << 16) | top for _ in range(1500)}
    lone = {(rng.getrandbits(48) << 16) | 0b1010, min(crowd) ^ 1 ^ (1 << 20) ^ (1 << 40)}
    fps = sorted(crowd | lone)
    real = simhash._verify

    def strict(radius):
        run = real(radius)

        def checked(batches):
            batches = list(batches)
            assert all(len(x) <= 100 for b in batches for x in b.column(0))
            yield from run(batches)

        return checked

    monkeypatch.setattr(simhash, "_verify", strict)
    reps = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    scratch = Scratch(spark, "test")
    got = dict(components(simhash.links(reps, scratch, 4, 4, 100), scratch).collect())
    assert [got.get(i, i) for i in range(len(fps))] == linked(fps, 4) and got


def test_groups(docs, empty):
    out = simhash.groups(docs).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        by.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {1, 2, 3} <= by[1] and by.pop(None) == {None} and all(k == min(v) for k, v in by.items())
    assert simhash.groups(empty).count() == 0


# --- tokens


def test_tokens(docs, empty):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = collected(tokens.token_counts(docs, P.path("piece_bpe_32k.model")))
    n = {r[0]: len(sp.encode(r[1] or "")) for r in rows()}
    assert got == sorted(((r[0], len((r[1] or "").encode()), n[r[0]], n[r[0]] > 4096) for r in rows()), key=repr)
    assert tokens.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_tokens_of_json(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = next(str(f) for f in sorted(__import__("pathlib").Path(P.path("piece_bpe_32k.model")).parent.glob("*.json")) if "model" in __import__("json").loads(f.read_text()))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs, path).collect()), key=repr)
    assert got == sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=repr)


def test_token_parts():
    import public_tokenizers as P

    c = tokens.Counter(open(P.path("piece_bpe_32k.model"), "rb").read(), "model")
    assert c.safe
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "▁", "\n", "é", "中", "<s>", "the", " x"]) for _ in range(80))
        assert sum(c.encode(tokens.parts(t, 10))) == c.encode([t])[0]
        assert " ".join(tokens.parts(t, 10)) == t


# --- licences


def test_licenses(spark):
    from tessella.llm.license_texts import KNOWN

    mit = KNOWN[0][1]
    known = spark.createDataFrame([*KNOWN, ("empty", " .. "), ("null", None)], "license_id string, text string")
    variants = [mit, mit.upper(), "Copyright (c) 2020 Somebody\n\n" + mit.replace("\n", " \n  ").replace(",", " ,"), mit.replace("sublicense", "sub-licence"), mit + " But not for you.", None, "", "...", "Released under the MIT Licence!", mit * 200]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(variants)] + [(0, mit, "x")], "doc_id long, text string, digest string")
    got = sorted((r["doc_id"], r["license_id"]) for r in licenses.scan(df.drop("digest"), known).collect() if r["license_id"])
    assert got == [(0, "MIT"), (0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (8, "notice:MIT")]
    out = {r["doc_id"]: r["digest"] for r in licenses.scan(df, known, 0).collect()}
    assert out[5] is None and out[6] == out[7] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(df.limit(0), known).count() == 0
    assert all(r["license_id"] is None for r in licenses.scan(df, known.limit(0)).collect())


def test_every_license_is_found(spark, tmp_path):
    """Each known text under another wrapping, case, spelling and copyright line, by the query and by its SQL."""
    import duckdb

    from tessella.llm import op7_licenses
    from tessella.llm.license_texts import KNOWN

    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MIT", "BSL-1.0", "0BSD"} <= {i for i, _ in KNOWN}
    shapes = [
        lambda t: t,
        lambda t: "Copyright (c) 2024 The Project\n\n" + " ".join(t.upper().split(" ")),
        lambda t: re.sub(r"\blicense\b", "licence", t).replace("\n", "\r\n").replace('"', "“"),
        lambda t: t + "\n\nOne more condition.",
    ]
    rows = [(len(shapes) * i + k, f(t)) for i, (_, t) in enumerate(KNOWN) for k, f in enumerate(shapes)] + [(-1, None), (-2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op7_licenses.op7_licenses(spark, str(tmp_path)).select("doc_id", "digest", "license_id").collect())
    ids = [KNOWN[i // len(shapes)][0] if i >= 0 and i % len(shapes) < 3 else None for i, _, _ in got]
    assert [x for _, _, x in got] == ids
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.sql(op7_licenses.SQL).project("doc_id, digest, license_id").fetchall()) == got


# --- decontamination

RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width):
    w = RUNS.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        q = RUNS.findall(low(t))
        k = min(width, len(q))
        for win in {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == win:
                    hit |= set(range(i, i + k))
                    found |= set() if item is None else {str(item)}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_pattern_groups_are_bounded(spark):
    """One huge item makes many groups."""
    text = " ".join(f"w{i}" for i in range(2000))
    found = decontaminate.pattern_groups(spark.createDataFrame([(1, text)], "item_id long, text string"), 10, 5000)
    sizes = [sum(map(len, g.value[0])) for g in found]
    assert len(found) > 10 and max(sizes) < 5200 and len({w for g in found for w in g.value[0]}) == 1991


@pytest.mark.parametrize("group_bytes", [64 << 20, 40])
def test_contamination(spark, group_bytes):
    rng = random.Random(4)
    words = ["a", "b", "ab", "é", "x1", "long" * 20, "中文"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 3, 5, 8, 12, 30, 9))] + [(8, None), (9, "..."), (5, "B b"), (10, "A-é; x1"), (None, "ab é ab é ab")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 60)))) for _ in range(60)]
    texts += [None, "", "--", items[6][1], "pre " + items[5][1].upper().replace(" ", " ,\n") + " post", " ".join(rng.choice(words) for _ in range(30_000))]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)] + [(0, texts[0], 1, "r")], "doc_id long, text string, n_hit int, row string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    got = collected(decontaminate.contamination(df, bench, width=4, group_bytes=group_bytes))
    assert got == sorted(((i, *brute_hits(t, items, 4)) for i, t in [*enumerate(texts), (0, texts[0])]), key=repr)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0


# --- chains, CRF and HMM


def test_chains():
    rng = np.random.default_rng(0)
    n, k = np.array([1, 4, 2, 300, 128, 129]), 3
    e, a, init = rng.random((n.sum(), k)) + 0.01, rng.random((k, k)), rng.random(k)
    post, moves, log = chains.forward_backward(e, a, init, n)
    assert np.allclose(log, chains.likelihood(e, a, init, n))
    at, total = 0, np.zeros((k, k))
    for i, m in enumerate(n):
        x = e[at : at + m]
        if m <= 4:  # every path
            paths = list(itertools.product(range(k), repeat=int(m)))
            w = np.array([init[p[0]] * x[0, p[0]] * math.prod(a[p[t - 1], p[t]] * x[t, p[t]] for t in range(1, m)) for p in paths])
            assert math.isclose(math.log(w.sum()), log[i], rel_tol=1e-9)
            for t in range(m):
                assert np.allclose([w[[p[t] == j for p in paths]].sum() / w.sum() for j in range(k)], post[at + t])
        al, be = np.zeros((m, k)), np.ones((m, k))
        p = init
        scale = np.zeros(m)
        for t in range(m):
            al[t] = p * x[t]
            scale[t] = al[t].sum()
            al[t] /= scale[t]
            p = al[t] @ a
        for t in range(m - 2, -1, -1):
            be[t] = a @ (x[t + 1] * be[t + 1]) / scale[t + 1]
        for t in range(m - 1):
            total += a * np.outer(al[t], x[t + 1] * be[t + 1]) / scale[t + 1]
        assert math.isclose(np.log(scale).sum(), log[i], rel_tol=1e-9)
        assert np.allclose(al * be, post[at : at + m])
        at += m
    assert np.allclose(moves, total)


def test_language_words():
    w = crf.Words(pa.array(["Hello, wörld 12x", None, "", "  a", "!!", "b c "]))
    assert [w.text[a + 1 : b].tobytes().decode() for a, b in zip(w.lead, w.trail, strict=True)] == ["hello", "wörld", "x", "a", "b", "c"]
    assert w.upto.tolist() == [0, 3, 3, 3, 4, 4, 6]


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = crf.fit(*crf.sample(d))
    held = d.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1)
    out = crf.predict(held, model).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_language_code_switch():
    rng = random.Random(0)
    sides = {"xx": ["alpo", "belo", "calo", "delto", "elmo"], "yy": ["griq", "hruq", "jaqu", "kiqa", "liqe"]}
    text = lambda s, n: " ".join(rng.choice(sides[s]) for _ in range(n))
    labels = ["xx", "yy"] * 20
    model = crf.fit([text(s, 60) for s in labels], labels)
    lang, score = model.label(pa.array([text("xx", 30) + " " + text("yy", 10), text("yy", 9), "", None, "12 34", "— “☃” \U0001f600"]))
    assert lang == ["xx", "yy", "und", "und", "und", "und"] and abs(score[0] - 0.75) < 0.05 and score[1] > 0.95 and score[2] == 0


def test_language_predictions(spark):
    """Labels and scores of whole texts from the fitted weights: features, lexicon and recursion spelled out for each word."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).cache()
    model = crf.fit(*crf.sample(d, crf.CrfParams(per_lang=10, epochs=1)))
    got = {r["doc_id"]: r for r in crf.predict(d, model).collect()}
    mul, k = 0x9E3779B97F4A7C15, len(model.langs)
    slot = lambda x: (x * mul & (1 << 64) - 1) >> 64 - model.bits
    known = {int(h): row for h, row in zip(model.lex_keys, model.lex[:-1], strict=True)}
    number = lambda b: int.from_bytes(b, "little")
    for r in d.collect()[:15]:
        words = re.findall(rb"[a-z\x80-\xff]+", r["text"].lower().encode())[:400]
        if len(re.findall(rb"[a-z\x80-\xff]+", r["text"].lower().encode())) > 400 or not words:
            continue
        e = np.zeros((len(words), k))
        hashes = crf.Words(pa.array([b" ".join(words).decode()])).hashes()
        for i, w in enumerate(words):
            e[i] = known.get(int(hashes[i]), model.lex[-1])
            padded = b" " + w + b" "
            for n in crf.GRAMS:
                for j in range(len(padded) - n + 1):
                    e[i] += model.tables[f"gram{n}"][slot(number(padded[j : j + n]))]
            e[i] += model.tables["prefix"][slot(number(w[:5]) + 1)] + model.tables["suffix"][slot(number(w[-5:]) + 1)]
        x, a = np.exp(e - e.max(1, keepdims=True)) + 1e-30, np.exp(model.trans)
        al, be = np.zeros_like(x), np.ones_like(x)
        for t in range(len(words)):
            al[t] = (np.exp(model.init) if t == 0 else al[t - 1] @ a) * x[t]
            al[t] /= al[t].sum()
        for t in range(len(words) - 2, -1, -1):
            be[t] = a @ (x[t + 1] * be[t + 1])
            be[t] /= be[t].sum()
        post = al * be
        total = (post / post.sum(1, keepdims=True)).sum(0)
        assert got[r["doc_id"]]["lang_pred"] == model.langs[total.argmax()]
        assert math.isclose(got[r["doc_id"]]["score"], total.max() / len(words), rel_tol=1e-5)


def test_language_sample(spark):
    """Every language is drawn from, whatever their number; long texts give a stretch; rows of one id don't exceed the quota."""
    p = crf.CrfParams(per_lang=3, max_docs=90, max_chars=50)
    docs = [(i, f"w{i % 300} " * 40, f"l{i % 300:03d}") for i in range(900)] + [(5000, f"x {i}", "many") for i in range(200)] + [(6000, None, "none"), (6001, "12", "none")]
    texts, labels = crf.sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"), p)
    drawn = Counter(labels)
    of = {lang for i, t, lang in docs if t and i != 6001 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(drawn) == of and max(drawn.values()) == 1 and max(map(len, texts)) <= 50
    model = crf.fit(texts, labels, crf.CrfParams(epochs=1, weights=1 << 18))
    assert len(model.langs) == len(of) and model.bits == crf.bits_for(len(of), 1 << 18) == 8
    assert crf.bits_for(4, 16 << 20) == 15 and crf.bits_for(1000, 16 << 20) == 12


def test_language_sample_of_repeated_ids(spark):
    """Null ids, repeated ids in training and rows that are all alike: every language has its quota, or all its rows."""
    p = crf.CrfParams(per_lang=150, max_docs=90_000)
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(None, f"english words {i}", "en") for i in range(300)] + [(None, f"deutsche Woerter {i}", "de") for i in range(2000)]
    docs += [(train[i % 5], f"mots {i}", "fr") for i in range(2000)] + [(train[0], "igual", "es")] * 2000 + [(None, "kaikki", "fi")] * 90
    got = Counter(crf.sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"), p)[1])
    assert got == {"en": 150, "de": 150, "fr": 150, "es": 150, "fi": 90}


def test_language_edges(docs, empty):
    model = crf.fit(*crf.sample(docs))
    out = {(r["doc_id"], r["lang_pred"]) for r in crf.predict(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= out
    assert crf.predict(empty, model).count() == 0 and crf.fit(*crf.sample(empty)) is None
    assert {r["lang_pred"] for r in crf.predict(docs, None).collect()} == {"und"}


def test_hmm(docs):
    held = lambda c: crc_mod(c, 10) == 0
    p = hmm.HmmParams(states=3, head=12, sample_docs=30, sample_steps=3)
    out = hmm.score(docs, held(F.col("doc_id")), p).toPandas()
    toks = [(r[0], [*WORD.findall(low(r[1])), "\n"]) for r in rows()]
    out_of = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in toks}
    c = Counter(w for i, t in toks if not out_of[i] for w in t)
    n, v = sum(c.values()), len(c)
    num = lambda i: -1 if i is None or i != i else int(i)
    want = sorted((num(i), out_of[i], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 3)) for i, t in toks)
    got = sorted((num(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out.itertuples())
    assert got == want
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()


def forward(symbols, m):
    """log10 of the likelihood, one plain step after the other."""
    at, log = np.asarray(m.init, float), 0.0
    for s in symbols:
        at = at * m.emit[s]
        log += math.log10(at.sum())
        at = at / at.sum() @ m.trans
    return log


def test_hmm_scores(spark, docs):
    """Whole scores from the fitted parameters, by an own forward pass and own counts; the parameters are distributions."""
    held = crc_mod(F.col("doc_id"), 10) == 0
    p = hmm.HmmParams(states=3, head=9, listed=14, sample_docs=30, sample_steps=3)
    scratch = Scratch(spark, "test")
    t = hmm.train(docs, held, p, scratch)
    m = t.model
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.trans.sum(1), 1) and np.isclose(m.init.sum(), 1) and np.isclose(t.base.sum(), 1)
    toks = [(r[0], WORD.findall(low(r[1]))) for r in rows()]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in toks if not out_of(i) for w in ws)
    n, v = sum(c.values()) + sum(not out_of(i) for i, _ in toks), len(c) + 1
    assert (t.total, round(t.whole, 6)) == (n, round(n + 0.1 * (v + 1), 6))
    head = sorted(c, key=lambda w: (-c[w], w.encode()))[:9]
    share = {w: (c[w] + 0.1) / t.whole for w in c}
    # the words that are one symbol to the chain, and the unknown word, share its base probability
    assert math.isclose(sum(x for w, x in share.items() if w not in head) + 0.1 / t.whole, t.base[hmm.OTHER], rel_tol=1e-9)
    want = []
    for i, ws in toks:
        log = forward([head.index(w) + 2 if w in head else hmm.OTHER for w in ws] + [hmm.END], m)
        log += sum(math.log10(share.get(w, 0.1 / t.whole) / t.base[hmm.OTHER]) for w in ws if w not in head)
        want.append((-1 if i is None else i, log))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in hmm.score(docs, held, p).collect())
    for (i, x), (j, y) in zip(got, sorted(want), strict=True):
        assert i == j and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-4)


def test_hmm_is_a_distribution(spark):
    """The probabilities of all texts of up to two words, and of what begins with two words, add up to one."""
    train = ["a b c", "a a", "b", "c d e a b", "a b a b"]
    words = [*"abcde", "?"]
    texts = ["", *words, *[" ".join(x) for x in itertools.product(words, repeat=2)]]
    df = spark.createDataFrame([*enumerate(train), *[(100 + i, t) for i, t in enumerate(texts)]], "doc_id long, text string")
    p = hmm.HmmParams(states=2, head=3, listed=4, sample_docs=5, sample_steps=2, passes=1)
    out = hmm.score(df, F.col("doc_id") >= 100, p).where("doc_id >= 100").toPandas()
    m = hmm.train(df, F.col("doc_id") >= 100, p, Scratch(spark, "test")).model
    at = m.init
    for _ in range(2):  # two symbols, neither of them the end
        at = (at * (1 - m.emit[hmm.END])) @ m.trans
    longer = float((at * (1 - m.emit[hmm.END])).sum())
    assert len(out) == len(texts) and math.isclose((10 ** out["score"]).sum() + longer, 1, rel_tol=1e-5)


def test_hmm_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = sorted(tuple(r) for r in hmm.score(df, F.lit(True)).collect())
    assert [(r[0], *r[2:5]) for r in out] == [(1, 3, 0, 0), (2, 1, 0, 0)] and all(abs(r[5]) < 1e-9 and -4 < r[6] < 0 for r in out)


def test_hmm_empty(empty):
    assert hmm.score(empty, F.col("doc_id") == 0).count() == 0


def test_hmm_learns(spark):
    rng = random.Random(1)
    make = lambda s: " ".join(rng.choice(s) for _ in range(40))
    one, two = "aa bb cc dd ee".split(), "vv ww xx yy zz".split()
    df = spark.createDataFrame([(i, make(one if i % 2 else two)) for i in range(200)], "doc_id long, text string")
    out = hmm.score(df, F.col("doc_id") % 10 < 2, hmm.HmmParams(states=2, head=20)).where("held_out").toPandas()
    assert (out["score"] > out["base_score"] + 5).all()


def test_hmm_expects_over_whole_texts():
    """The sums of texts of several lanes are those of one recursion over each text."""
    rng = np.random.default_rng(2)
    n, k = np.array([1, 700, 256, 257, 3000]), 3
    m = hmm.Hmm(np.array([0.98, 0.01, 0.01]), rng.dirichlet(np.ones(k), k) * 0.1 + 0.9 * np.eye(k), rng.dirichlet(np.ones(k), 40))
    ids = rng.integers(0, 40, n.sum())
    post, moves, _ = chains.forward_backward(m.emit[ids], m.trans, m.init, n, lane=int(n.max()))
    got = hmm.expected(ids, n, m, 256)
    emit = np.stack([np.bincount(ids, post[:, j], 40) for j in range(k)], 1)
    for have, want in zip(got, (post[np.cumsum(n) - n].sum(0), moves, emit), strict=True):
        assert np.allclose(have, want, rtol=1e-4)


def test_hmm_head_is_of_all_training_texts(spark, docs):
    """Most words are in no text that is short enough for the sample."""
    rng = random.Random(1)
    make = lambda s: " ".join(rng.choice(s) for _ in range(40))
    one, two = "aa bb cc dd ee".split(), "vv ww xx yy zz".split()
    df = spark.createDataFrame([*((i, make(one if i % 2 else two)) for i in range(200)), *((209 + 10 * i, "aa " * 9 if i % 2 else "vv " * 9) for i in range(200))], "doc_id long, text string")
    out = hmm.score(df, F.col("doc_id") % 10 < 2, hmm.HmmParams(states=2, head=20, sample_chars=30, passes=6)).where("held_out").toPandas()
    assert (out["score"] > out["base_score"] + 5).all()
    held = crc_mod(F.col("doc_id"), 10) == 0
    c = Counter(w.encode() for r in rows() if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 for w in WORD.findall(low(r[1])) if len(w) <= 64)
    words = Scratch(spark, "test").write(hmm.word_counts(docs, held))
    for n in (1, 7, 20, 10**6):
        assert [w for w, _ in hmm.top_words(words, n) if w[0] < 255] == sorted(c, key=lambda w: (-c[w], w))[:n]


# --- components


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_components(spark, monkeypatch, chunk):
    """Chains, a hub, loops and repeated edges; a chunk of three edges leaves the work to the rounds."""
    from tessella.operators import components as C

    real = C._contract
    monkeypatch.setattr(C, "_contract", lambda batches: (out for b in batches for k in range(0, b.num_rows, chunk) for out in real(iter([b.slice(k, chunk)]))))
    monkeypatch.setattr(C, "hot_rows", lambda rows: 5)
    if chunk == 3:
        monkeypatch.setattr(C, "LOT", 1)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = dict(components(df, Scratch(spark, "test")).collect())
    edges = edges[:-1]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(k, k) == v for k, v in label.items())
    assert components(df.limit(0), Scratch(spark, "test")).count() == 0
