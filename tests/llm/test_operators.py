"""Corpus operators against brute force on a small table with awkward rows."""

import hashlib
import random
import textwrap
import zlib
from math import floor

import brute
import pytest
from pyspark.sql import functions as F

from factweave.llm import decontaminate, hmm, licenses, mixing, neardup, quality, rowkeys, sharding, simhash, substrings, urls, warc
from factweave.llm.shared import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, __x string"
PASSAGE = " ".join(f"passage{i}" for i in range(20))


def rows():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    out = []
    for d in range(60):
        words = rng.choices(pool, k=rng.choice([0, 1, 3, 12, 13, 60, 200]))
        text = " ".join(words)
        if d % 5 == 0:
            text = f"Start {d} of it, {PASSAGE} and\t the\n end é {d} #|<"
        if d % 7 == 0 and out:
            text = out[rng.randrange(len(out))][1]
        if d % 11 == 0:
            text = "\n".join(["same line again and again it goes"] * 9) + f"\nx {d}"
        out.append((d, text, "en", [None, "b", "a", "a", "a"][d % 5], len(text or ""), 1, 2, "x"))
    long = " ".join(rng.choices(pool, k=30000))
    edge = [(100, None), (101, ""), (102, " \n\t "), (103, long), (104, long), (None, PASSAGE + " null id"), (None, PASSAGE + " null id"), (105, "x" * 300000), (106, "Ünïcode" * 3)]
    out += [(d, t, None, None, None, None, None, None) for d, t in edge]
    return out + [out[3], out[3], out[20]]


ROWS = rows()
DOCS = [(r[0], r[1]) for r in ROWS]
ITEMS = [(7, PASSAGE), (71, " ".join(f"Passage{i}" for i in range(3, 18))), (8, "End É"), (9, None), (10, "..."), (11, "nowhere to be found"), (8, "End É")]
key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def same(df, expected):
    assert got(df) == sorted(expected, key=key)


def test_quality(docs, empty):
    f = lambda d: d.withColumn("m", quality.quality_measures(F.col("text"))).select("doc_id", *[f"m.{c}" for c in quality.FIELDS[:5]], *quality.verdict(F.col("m")), "m.covered_words", "m.longest_repeat")
    same(f(docs), brute.op6(DOCS))
    assert f(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")

    def f(d, **o):
        h = F.col("hits")
        out = decontaminate.benchmark_hits(d, items, **o)
        return out.select("doc_id", h["n_words"], h["n_hit"], F.size(h["items"]), F.sha2(F.array_join(F.array_sort(h["items"]), ",").cast("binary"), 256), decontaminate.contaminated(h))

    same(f(docs), brute.op9(DOCS, ITEMS))
    assert f(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, none).agg(F.sum("hits.n_hit")).first()[0] == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    test_decontamination(spark, docs, docs.limit(0))


def test_removal_spans(spark):
    d = spark.createDataFrame([(1, f"Keep this. {PASSAGE}! And this."), (2, "Nothing here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = decontaminate.benchmark_hits(d, items).select("doc_id", decontaminate.without_spans(F.col("text"), F.col("hits.spans")))
    assert dict(map(tuple, out.collect())) == {1: "Keep this. ! And this.", 2: "Nothing here", 3: None}


def test_substrings(docs, empty):
    f = lambda d, **o: substrings.deduplicate(d, **o).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256))
    expected = brute.op10(DOCS)
    same(f(docs), expected)
    same(f(docs, batches=6, fanout=2), expected)
    assert f(empty).count() == 0


def test_substrings_in_shared_files(spark, docs, tmp_path, monkeypatch):
    """Over 100 buckets: a run has a file for several of them, before and after merging, and each finds its own there."""
    monkeypatch.setattr(substrings, "BUCKET", 7000)
    monkeypatch.setattr(substrings, "shared_folder", lambda *_: f"file://{tmp_path}/index")
    runs = []
    add = substrings.FingerprintIndex.add
    monkeypatch.setattr(substrings.FingerprintIndex, "add", lambda self, part: (add(self, part), runs.append((1 << self.bits, list(self.runs))))[0])
    out = substrings.deduplicate(docs, batches=5, fanout=2).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256))
    same(out, brute.op10(DOCS))
    buckets, (last,) = runs[-1]
    held = spark.read.parquet(last).where("kind = 'run'")
    assert buckets > 100
    assert held.select("bucket").distinct().count() == held.count() == buckets
    files = held.select("bucket", F.input_file_name().alias("f")).distinct()
    assert files.count() == buckets and files.select("f").distinct().count() <= 32


def test_simhash(spark, docs, empty):
    near = " ".join(f"n{i}" for i in range(400))
    more = [(200 + i, near.replace(f"n{7 * i + 1} ", "changed ")) for i in range(12)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = simhash.near_duplicates(d).select("doc_id", simhash.hex_digits(F.col("f")), "component_id")
    same(out, brute.op3(DOCS + more))
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {r[2] for r in brute.op3(DOCS)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_near_duplicates_of_the_pipeline(spark, empty):
    rng = random.Random(9)
    texts = []
    for size in (3, 5, 60, 60, 200, 400, 1000):
        base = rng.choices([f"v{i}" for i in range(500)], k=size)
        texts.append(" ".join(base))
        for changes in (0, 1, size // 60, size // 50, size // 45, size // 40, size // 25):
            copy = list(base)
            for i in rng.sample(range(size), min(changes, size)):
                copy[i] = f"new{rng.random()}"
            texts.append(" ".join(copy) if changes else "  ".join(copy).upper())
    texts += [None, "", " \n", None, texts[20], texts[20]]
    rows_ = [(None if i % 13 == 5 else i, t, "x") for i, t in enumerate(texts)] + [(20, texts[20], "x")]
    rng.shuffle(rows_)
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(brute.words(brute.lower(t))) for _, t, _ in rows_]
    root = list(range(len(rows_)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, t, _), r in zip(rows_, root, strict=True):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    d = spark.createDataFrame(rows_, "doc_id long, text string, z string").repartition(3)
    kept = neardup.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(least.values())
    # Copies that fingerprints at 4 bits don't link, as the stage did before.
    bits = {r.doc_id: int(r.h, 16) for r in d.select("doc_id", simhash.hex_digits(simhash.fingerprint(F.col("text"))).alias("h")).collect()}
    assert any((bits[rows_[i][0]] ^ bits[rows_[j][0]]).bit_count() > 4 for i, j in pairs)
    assert neardup.one_of_each(empty).count() == 0
    # The same in blocks of a few texts, which are held against each other two at a time.
    neardup.MEMBERS, old = 3, neardup.MEMBERS
    try:
        again = neardup.one_of_each(d)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in again.collect()) == sorted(least.values())
    finally:
        neardup.MEMBERS = old


def test_a_group_in_several_parts(spark, monkeypatch):
    """Texts that hang together by postings but not all by links: blocks find the same parts as one task."""
    rng = random.Random(12)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for i in rng.sample(range(120), rng.choice([1, 2, 5, 6])):
            copy[i] = f"c{rng.randrange(10)}"
        texts.append(" ".join(copy))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = sorted({min(i for i in range(60) if root[i] == r) for r in root})
    assert 2 < len(least) < 60
    for members in (512, 7):
        monkeypatch.setattr(neardup, "MEMBERS", members)
        assert sorted(r.doc_id for r in neardup.one_of_each(d).collect()) == least


def test_postings_split_like_whole():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    f = np.unique(np.concatenate([base, base ^ flips])) & ~np.uint64(0xFFFF)
    f = np.unique(f)

    def parts(split):
        old, simhash.SPLIT = simhash.SPLIT, split
        forest = simhash._Forest()
        for a, b in simhash.posting_links(f, (0, 1), 4):
            forest.join(a, b)
        simhash.SPLIT = old
        return [forest.root(int(x)) for x in f]

    assert parts(16) == parts(1 << 20)
    assert len(set(parts(16))) < len(f)


def slim(d):
    return d.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("m"))


def brute_mix(groups, blocks_of):
    """Copies of each row from Spark's targets, rates and blocks: a plain walk over the order."""
    taken = {}
    for source in {g.source for g in groups}:
        place = 0
        for g in sorted((g for g in groups if g.source == source), key=lambda g: (blocks_of[g], g.size, g.id is not None, g.id or 0, g.m)):
            assert g.before == place
            for _ in range(g.n):
                place += 1
                step = floor(place * g.rate + g.offset) - floor((place - 1) * g.rate + g.offset)
                taken.setdefault((g.id, g.source, g.size, g.m), []).append(step)
    return taken


def test_mixing(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    out = mixing.expected_copies(slim(docs)).collect()
    sizes = {}
    for _, t, _, s, *_ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    targets = brute.op4_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert len(out) == len(ROWS)
    assert abs(taken["b"] - targets["b"]) <= max(200, 0.3 * targets["b"])
    groups = mixing.sampled(slim(docs)).collect()
    n = {}
    for g in groups:
        n[g.source] = n.get(g.source, 0) + g.n
    block = lambda g: int(int(hashlib.md5("|".join(["mix-1", "\0" if g.id is None else str(g.id), g.m]).encode()).hexdigest()[:8], 16) / 2**32 * -(-n[g.source] // 8))
    plain = brute_mix(groups, {g: block(g) for g in groups})
    spark_ = {}
    for r in out:
        spark_.setdefault((r.id, r.source, r.size, r.m), []).append(r.copies)
    assert {k: sorted(v) for k, v in spark_.items()} == {k: sorted(v) for k, v in plain.items()}
    blank = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == 0


def test_mixture_of_rows(docs, empty, spark):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(got(mixing.mix(docs.repartition(5))), key=key) == got(mixed)
    assert set(got(mixed)) <= set(got(docs)) and mixing.mix(empty).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("n", "rate", "offset", "blocks", "before", "block", "id", "target", "copies", "s", "b")})
    assert got(mixing.mix(clash).select("doc_id")) != [] and mixing.mix(clash).columns == clash.columns
    words = sum(len(brute.words(t)) for _, t in DOCS)
    taken = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(taken - 1.5 * words) < 0.2 * words


def test_rows_repeated_without_end(spark, monkeypatch):
    """A row repeated 20,000 times and 3,000 null ids: as many rows come out as went in, dealt in portions."""
    monkeypatch.setattr(rowkeys, "PORTION", 512)
    d = spark.range(23000).select(F.when(F.col("id") < 20000, 7).cast("long").alias("doc_id"), F.when(F.col("id") < 20000, "same words here").otherwise(F.concat_ws(" ", F.lit("words"), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    out = sharding.interleave(d, 24).cache()
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) == 23000 and len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    assert out.select("shard", "slot").distinct().count() == 23000 and out.where("doc_id = 7").count() == 20000
    keys = rowkeys.keyed(d).select(F.col("doc_id").alias("id"), F.col("source").alias("src"), *rowkeys.KEY)
    placed = sharding.places(keys, 24)
    assert placed.groupBy(*rowkeys.KEY, "__portion").count().agg(F.max("count")).first()[0] <= 512
    groups = mixing.sampled(d.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"), F.md5("text").alias("m")))
    assert groups.where("id is null").count() == 3000
    # 150 % of 66,000 words, two or three words a row.
    mixed = mixing.mix(d).groupBy(F.col("doc_id").isNull().alias("none")).count().collect()
    taken = {r.none: r["count"] for r in mixed}
    assert abs(taken[False] * 3 + taken[True] * 2 - 99000) < 3000 and 29000 < taken[False] < 31000


def test_sharding(docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    d = docs.select("doc_id", "source", sharding.text_crc32(F.col("text")).alias("c"), sharding.row_size(F.col("text")).alias("b"), F.lit(9).alias("shard"))
    out = sharding.interleave(d, 7).collect()
    assert len(out) == len(ROWS)
    expected = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for _, t in DOCS)
    assert sorted((r.c, r.b) for r in out) == expected
    # The same order by a plain sort: rows of each source by their seeded hash, then all by fractional rank.
    rows_ = rowkeys.keyed(d.drop("shard")).withColumn("h", sharding.shuffle_key(sharding.SEED, F.col("doc_id"), *map(F.col, rowkeys.KEY))).collect()
    ranked = []
    for s in {r.source for r in rows_}:
        own = sorted((r for r in rows_ if r.source == s), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r[rowkeys.KEY[0]], r[rowkeys.KEY[1]]))
        ranked += [((i + 0.5) / len(own), r.source is None, r.source or "", r.h, r[rowkeys.KEY[0]], r[rowkeys.KEY[1]], r) for i, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:6])
    plain = []
    for k in range(7):
        cut = ranked[-(-k * len(ranked) // 7) : -(-(k + 1) * len(ranked) // 7)]
        plain += [(x[-1].doc_id, x[-1].source, x[-1].c, x[-1].b, k, i) for i, x in enumerate(cut)]
    assert sorted(((r.doc_id, r.source, r.c, r.b, r["shard"], r.slot) for r in out), key=key) == sorted(plain, key=key)
    assert sharding.interleave(empty, 7).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    cases = {
        "http://a.example.com/en/1": "block", "http://a.example.com/en/77?x": "allow", "http://EXAMPLE.com/en/8": "block", "http://badexample.com/en/7": "block", "https://x.net/de/1": "allow", "https://q.example.net/de/81": "block",
        "http://x.org/es/#a": "block", "http://x.org/fr/": "allow", "no scheme": "allow", "http://com?/en/": "allow", "http://com/en/": "block", "": "allow", None: "allow",
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string")
    out = urls.judge_urls(pages, rules).collect()
    assert len(out) == 2 * len(cases)
    for r in out:
        assert r.verdict == cases[r.url], r
    assert {r.rule for r in out if r.url == "https://q.example.net/de/81"} == {"example.net/de/8"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 2 * len(cases)


def test_urls_of_a_common_host(spark):
    """Without broadcast: one host has nearly all URLs, many rules share the empty path, some are repeated."""
    rows_ = [(i, f"http://w{i % 3}.example.com/en/{i}" if i % 9 else f"http://h{i}.org/{i}") for i in range(3000)]
    made = [("block", "com", ""), ("block", "com", ""), *[("allow" if i % 2 else "block", "example.com", f"/en/{i}") for i in range(40)], *[("block", f"h{i}.org", "") for i in range(0, 3000, 18)]]
    rules = spark.createDataFrame(made, "verdict string, host string, path string")

    def expected(url):
        host, path = url[7:].split("/", 1)
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in made if ("." + host).endswith("." + h) and ("/" + path).startswith(p)]
        return max(fits)[2:] if fits else ("allow", None)

    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = urls.judge_urls(spark.createDataFrame(rows_, "page_id long, url string"), rules).collect()
    finally:
        spark.conf.set(key, usual)
    assert {r.page_id: (r.verdict, r.rule) for r in out} == {i: expected(u) for i, u in rows_} and len(out) == len(rows_)


def test_warc_round_trip(spark):
    big = "z" * 100 + "é" * 60000
    noise = "".join(chr(random.Random(1).randrange(0x20, 0x2FFF)) for _ in range(100)) * 400
    pages = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", noise), (None, "u", big), (9, "u", big), (8, "u", "\x1f\x8b\x08" * 50)]
    path = shared_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path)
    for size in (700, 1 << 22):
        out = warc.read_warc(spark, path, size)
        page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
        same(out.select(page("record_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to")), brute.op2(pages))
    bodies = {r.record_id: r.payload.decode() for r in out.where("record_type = 'response'").collect()}
    assert bodies["urn:page:3"] == big and bodies["urn:page:7"] == noise and bodies["urn:page:4"] == ""
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), p2 := shared_folder(spark, "warc-none"))
    assert warc.read_warc(spark, p2).count() == 0


def test_warc_long_headers():
    import gzip
    import io

    rng = random.Random(4)
    urls_ = ["http://a/" + "".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(75000)), "http://a/" + "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000)), "http://b/"]
    members = [warc._record(str(i), u, "d", 4, b"body", None) for i, u in enumerate(urls_)]
    data = b"".join(m + warc.EMPTY_MEMBER for m in members)
    out = list(warc.scan_range(io.BytesIO(data), 0, len(data)))
    assert [(h["warc-record-id"], b) for _, h, b in out] == [(f"<urn:page:{i}>", b"body") for i in range(3)]
    assert [h["warc-target-uri"] for _, h, _ in out] == [warc.quote(u, safe="%:/?#[]@!$&()*+,;=-._~'") for u in urls_]
    endless = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n")
    with pytest.raises(ValueError, match="without header end"):
        list(warc.scan_range(io.BytesIO(endless), 0, len(endless)))


def test_hmm(docs, empty):
    out = sorted((tuple(r) for r in hmm.score_texts(docs, rounds=2).collect()), key=lambda r: key(r[:5]))
    expected = sorted(brute.op5_base(DOCS), key=lambda r: key(r[:5]))
    assert [r[:5] for r in out] == [r[:5] for r in expected]
    for o, e in zip(sorted((r[0] or -1, round(r[5], 6)) for r in out), sorted((r[0] or -1, round(r[5], 6)) for r in expected), strict=True):
        assert o == pytest.approx(e, abs=1e-5)
    assert all(r[6] < 0 for r in out)
    assert hmm.score_texts(empty, rounds=1).count() == 0


def random_model(rng):
    import numpy as np

    norm = lambda x: x / x.sum(-1, keepdims=True)
    s, v = hmm.STATES, hmm.OWN
    return hmm.Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(hmm.RARE), np.zeros(hmm.RARE), 1, 1, 1, norm(rng.random(s)), norm(rng.random((s, s))), norm(rng.random((s, v))))


def plain_counts(texts, m):
    """Baum-Welch expected counts by the textbook recursions, each text as one sequence."""
    import numpy as np

    begin, moves, emits, logs = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros(m.emits.shape), 0.0
    for t in texts:
        alpha, scale = [], []
        for i, x in enumerate(t):
            a = (m.start if i == 0 else alpha[-1] @ m.moves) * m.emits[:, x]
            scale.append(a.sum())
            alpha.append(a / scale[-1])
        beta = np.ones(hmm.STATES)
        for i in range(len(t) - 1, -1, -1):
            emits[:, t[i]] += alpha[i] * beta
            if i:
                ahead = m.emits[:, t[i]] * beta / scale[i]
                moves += np.outer(alpha[i - 1], ahead) * m.moves
                beta = m.moves @ ahead
            else:
                begin += alpha[0] * beta
        logs += np.log(scale).sum()
    return np.concatenate([begin, moves.ravel(), emits.ravel(), [logs]])


@pytest.mark.parametrize("piece", [1 << 20, 70, 1])
def test_hmm_trains_on_whole_texts(monkeypatch, piece):
    import numpy as np

    monkeypatch.setattr(hmm, "PIECE", piece)
    rng = np.random.default_rng(1)
    m = random_model(rng)
    texts = [rng.integers(0, hmm.OWN, n) for n in (1, 300, 65, 64, 1, 129, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got_, plain = hmm.expected(np.concatenate(texts), offsets, m), plain_counts(texts, m)
    assert got_ == pytest.approx(plain, rel=2e-3, abs=1e-5)
    scores = hmm.log10_likelihood(np.concatenate(texts), offsets, m)
    assert scores == pytest.approx([plain_counts([t], m)[-1] / np.log(10) for t in texts])


def test_hmm_score_of_a_table(spark):
    """The score column by brute force: counts, classes, Baum-Welch and forward recursion in plain Python."""
    import numpy as np

    rng = random.Random(8)
    texts = [(f"d{i}", " ".join(rng.choices([f"W{k}{'abc'[k % 3]}" for k in range(4000)], [1 / (k + 100) for k in range(4000)], k=rng.choice([0, 5, 600])))) for i in range(40)]
    own_words = hmm.TOP + round(hmm.GROWTH * sum(len(t) for _, t in texts) ** (1 / 3))
    assert len({w for _, t in texts for w in t.split()}) > own_words + 100
    assert own_words > hmm.TOP + 50
    held = [zlib.crc32(d.encode()) % 7 == 2 for d, _ in texts]
    chunk = hmm.coded([(d, h, t.encode()) for (d, t), h in zip(texts, held, strict=True)])
    from factweave.llm.words import word_hashes

    words = sorted({w for _, t in texts for w in brute.lower(t).split()})
    number = dict(zip(words, (int(x) for x in word_hashes([w.encode() for w in words])[:, 0]), strict=True))
    cls = {w: (ord(w[-1]) * 31 + (ord(w[-2]) if len(w) > 1 else 0) * 37) % hmm.RARE for w in words}
    count = {w: sum(brute.lower(t).split().count(w) for (_, t), h in zip(texts, held, strict=True) if not h) for w in words}
    signed = lambda w: number[w] - (1 << 64) if number[w] >> 63 else number[w]
    top = sorted((w for w in words if count[w]), key=lambda w: (-count[w], signed(w)))[:own_words]
    top.sort(key=number.get)
    taken = set(top)
    rare = [w for w in words if w not in taken and count[w]]
    n, v = np.zeros(hmm.RARE), np.zeros(hmm.RARE)
    for w in rare:
        n[cls[w]] += count[w]
        v[cls[w]] += 1
    place = {w: hmm.OWN + i for i, w in enumerate(top)}
    symbol = {w: place.get(w, hmm.CLASS + cls[w]) for w in words}
    m = hmm.Model(np.array([number[w] for w in top], np.uint64), np.array([count[w] for w in top]), n.copy(), v.copy(), 0, 0, held.count(False), np.full(hmm.STATES, 1 / hmm.STATES), np.full((hmm.STATES, hmm.STATES), 0.1 / (hmm.STATES - 1)), np.zeros((hmm.STATES, hmm.OWN + len(top))))
    np.fill_diagonal(m.moves, 0.9)
    unigram = np.concatenate([[m.ends], n, m.top_counts]) + 0.1
    jitter = np.exp(0.7 * np.random.default_rng(7).standard_normal(m.emits.shape))
    jitter[:, hmm.END] = 1
    m.emits = unigram * jitter / (unigram * jitter).sum(1, keepdims=True)
    codes = [np.array([*(symbol[w] for w in brute.lower(t).split()), hmm.END]) for _, t in texts]
    for _ in range(3):
        m = hmm.reestimated(m, plain_counts([c for c, h in zip(codes, held, strict=True) if not h], m))
    expected = {}
    for (d, t), c in zip(texts, codes, strict=True):
        share = sum(np.log10((count[w] + 1) / (n[cls[w]] + v[cls[w]] + 1)) for w in brute.lower(t).split() if w not in taken)
        expected[d] = plain_counts([c], m)[-1] / np.log(10) + share
    assert chunk["ids"] == [d for d, _ in texts]
    frame = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    out = {r.doc_id: r.score for r in hmm.score_texts(frame, rounds=3).collect()}
    assert set(out) == set(expected)
    for d, e in expected.items():
        assert out[d] == pytest.approx(e, rel=1e-3, abs=1e-3), d


def test_hmm_training_helps():
    import numpy as np

    rng = np.random.default_rng(1)
    m = random_model(rng)
    data = np.concatenate([rng.integers(0, 20, 500), rng.integers(100, 120, 500)])
    before = None
    for _ in range(4):
        x = hmm.expected(data, np.array([0, 500, 1000]), m)
        assert x[hmm.STATES + hmm.STATES**2 : -1].sum() == pytest.approx(1000, rel=1e-4)
        assert before is None or x[-1] > before - 1e-3
        before, m = x[-1], hmm.reestimated(m, x)


def test_licenses(spark):
    texts = [
        (1, "Prose.\nReleased under the MIT License.\nMore"), (2, "Licensed under CC BY-NC 4.0."), (3, "this work is licensed under the GNU General Public Licence, version 3"), (4, "A license to speak freely"), (5, None), (6, ""),
        (7, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.explode(licenses.license_notices(F.col("text"))).alias("n"))
    found = sorted((r.doc_id, r.n.license, r.n.n_different) for r in d.collect())
    assert found == [(1, "MIT", 0), (2, "CC-BY-NC-4.0", 0), (3, "GPL-3.0", 2), (7, "Apache-2.0", 0), (7, "Apache-2.0", 0)]


def test_licenses_against_brute_force(spark):
    t = licenses.Templates(licenses.TEMPLATES, 0.15)
    rng = random.Random(6)
    names = sorted(licenses.TEMPLATES)
    texts = []
    for _ in range(30):
        words = rng.choices(["and", "license", "the", "Some", "version", "free,", "2.0.\n"], k=rng.randrange(12))
        for _ in range(2):
            notice = licenses.TEMPLATES[rng.choice(names)].split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(["other", "License", "words put in"])
            words += [*notice, *rng.choices(["more", "text.", "under"], k=rng.randrange(4))]
        texts.append(" ".join(words))
    d = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, block int, license int")
    out = d.select("doc_id", "block", F.explode(licenses.license_notices(F.col("text"))).alias("n")).collect()
    for i, x in enumerate(texts):
        own = [(r.n.license, r.n.n_different, r.n.wording) for r in out if r.doc_id == i]
        assert own == [m[1:] for m in brute.op1(x, licenses.TEMPLATES, t.sizes)], x
    assert d.limit(0).select(F.explode(licenses.license_notices(F.col("text")))).count() == 0
    long = "word " * 200000 + licenses.TEMPLATES["MIT"] + " word" * 200000
    assert [f["license"] for f in licenses.scan(long.encode(), t)] == ["MIT"]


def test_licenses_of_other_templates():
    own = {"Own": "Copying and pasting are welcome to all readers of these pages", "One": "gratis"}
    t = licenses.Templates(own, 0.15)
    assert [(f["license"], f["n_different"]) for f in licenses.scan(b"So, copying and pasting are welcome to all writers of these pages. Gratis!", t)] == [("Own", 2), ("One", 0)]
    assert licenses.scan(b"any text", licenses.Templates({}, 0.15)) == []


def test_licenses_within_other_text():
    t = licenses.Templates(licenses.TEMPLATES, 0.15)
    rng = random.Random(2)
    for name, notice in licenses.TEMPLATES.items():
        for n in (0, 40, 160):
            other = "".join(rng.choices("abcdefghij klmnop qrstuv", k=n)).strip()
            assert [(f["license"], f["n_different"]) for f in licenses.scan(f"{other} {notice}".encode(), t)] == [(name, 0)], (name, n)


def test_licenses_over_lines_and_several_in_a_line():
    t = licenses.Templates(licenses.TEMPLATES, 0.15)
    names = lambda x: [(f["block"], f["license"], f["n_different"]) for f in licenses.scan(x.encode(), t)]
    gpl = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3"
    bsd = licenses.TEMPLATES["BSD-3-Clause"].replace("without ", "without\n# ")
    assert names(gpl) == [(0, "GPL-3.0-header", 0)]
    assert names(f"Title\n{bsd}\nmore") == [(1, "BSD-3-Clause", 0)]
    assert names("Licensed under CC BY 4.0. Released under the MIT License.") == [(0, "CC-BY-4.0", 0), (0, "MIT", 0)]
    assert names("x " * 400 + "\nReleased under the MIT License. " * 3) == [(i, "MIT", 0) for i in (1, 2, 3)]
    for width in (20, 40, 72):
        for name, notice in licenses.TEMPLATES.items():
            lines = "\n * ".join(textwrap.wrap(f"Some words before it. {notice} And {'after ' * 90}", width))
            assert [n[1:] for n in names(lines)] == [(name, 0)]


def test_words_alike_to_polynomials(spark):
    """Two words of 1,024 letters whose polynomial sums agree modulo 2^64 for any odd base: they are different words."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    line = [f"w{i}" for i in range(12)]
    texts = [(1, " ".join([one, *line])), (2, " ".join([two, *line])), (3, " ".join([one, two, *line] * 8))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    out = substrings.deduplicate(d).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256))
    same(out, brute.op10(texts))
    items = [(1, texts[0][1])]
    h = F.col("hits")
    found = decontaminate.benchmark_hits(d, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", h["n_words"], h["n_hit"], F.size(h["items"]), F.sha2(F.array_join(h["items"], ",").cast("binary"), 256), decontaminate.contaminated(h))
    same(found, brute.op9(texts, items))
    m = quality.quality_measures(F.col("text"))
    same(d.select("doc_id", m.alias("m")).select("doc_id", "m.n_repeat_words", "m.covered_words", "m.longest_repeat"), [(r[0], r[5], r[8], r[9]) for r in brute.op6(texts)])
    known = {r.doc_id: r.n_known for r in hmm.score_texts(d.where("doc_id < 3"), rounds=1).collect()}
    assert known == {r[0]: r[3] for r in brute.op5_base(texts[:2])}


def test_ids_of_other_types(spark):
    texts = [(f"d{i}", t) for i, (_, t) in enumerate(DOCS[:40])] + [(None, DOCS[0][1]), ("d3", DOCS[5][1])]
    d = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id string, text string, id int, key int").repartition(3)
    out = substrings.deduplicate(d).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.coalesce("dedup.kept", F.lit("")).cast("binary"), 256))
    order = {k: i for i, k in enumerate(sorted({t[0] for t in texts if t[0]}))}
    expected = brute.op10([(order.get(k), t) for k, t in texts])
    names = {i: k for k, i in order.items()}
    same(out, [(names.get(r[0]), *r[1:]) for r in expected])
    scores = hmm.score_texts(d, rounds=1)
    assert scores.columns[0] == "doc_id" and sorted((r.doc_id for r in scores.collect()), key=str) == sorted((t[0] for t in texts), key=str)
    kept = {r.doc_id for r in neardup.one_of_each(d).collect()}
    assert kept <= {t[0] for t in texts} and mixing.mix(d.withColumn("source", F.lit("s"))).count() >= 0


def test_quality_only_by_the_method(spark):
    """A document that the base rule keeps and repeats reject, by their share and by the longest one."""
    rng = random.Random(3)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    part, long = fresh(9), fresh(20)
    texts = [(1, fresh(300)), (2, part + fresh(20) + part + fresh(20) + part + fresh(20)), (3, long + fresh(60) + long + fresh(50)), (4, part + fresh(200) + part)]
    texts = [(i, " ".join(t)) for i, t in texts]
    d = spark.createDataFrame([(*t, 0, "c") for t in texts], "doc_id long, text string, m int, n_words string")
    out = d.withColumn("q", quality.quality_measures(F.col("text"))).select("doc_id", *quality.verdict(F.col("q"))).collect()
    assert {r[0]: (r[1], r[2]) for r in out} == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, True)}
    assert [(r[6], r[7]) for r in brute.op6(texts)] == [(False, True), (False, False), (False, False), (False, True)]


def test_long_urls_and_other_columns(spark):
    rng = random.Random(2)
    long = "http://example.com/en/" + "".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(200000)).replace("?", "a").replace("#", "b")
    rows_ = [(1, long, "p" * 200, "x"), (2, "http://b/", "p" * 200, "y"), (2, "http://b/", "p" * 200, "y"), (3, long, "q", None)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, key string").withColumn("p", F.lit(1)).withColumn("value", F.lit(2))
    path = shared_folder(spark, "warc-long")
    warc.write_warc(pages, path)
    out = warc.read_warc(spark, path, 5000).select("record_id", "record_type", "refers_to", "payload_bytes", F.length("target_uri")).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in out) == [("urn:page:1", "response", None, 200), ("urn:page:2", "revisit", "urn:page:1", 200), ("urn:page:2", "revisit", "urn:page:1", 200), ("urn:page:3", "response", None, 1)]
    assert min(r[4] for r in out if r[0] != "urn:page:2") >= 200000
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    judged = urls.judge_urls(pages.withColumn("h", F.lit(1)).withColumn("digest", F.lit(1)), rules).collect()
    assert {(r.page_id, r.verdict) for r in judged} == {(1, "block"), (2, "allow"), (3, "block")} and len(judged) == 4


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    path = shared_folder(spark, "pipeline-test")
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS[:3], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = c.run(spark, path).collect()
    # Quality keeps what brute force keeps; one of each group; no benchmark passage is left.
    kept = [(r[0], r[1]) for r, q in zip(DOCS, brute.op6(DOCS), strict=True) if q[7]]
    assert {r.doc_id for r in out} <= {d for d, _ in kept}
    assert not any(PASSAGE in r.text for r in out)
    assert set(documents.columns) < set(out[0].asDict())
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    clash = documents.limit(40).withColumns({c: F.lit(1) for c in ("n", "rate", "before", "block", "f", "places", "hits", "m", "slot", "key", "id")})
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, clash, path).columns == clash.columns
        assert stage(spark, clash.drop("n_chars", "lang"), path).columns == [x for x in clash.columns if x not in ("n_chars", "lang")]
    assert {"shard", "slot"} <= set(c.shards(spark, clash, path).columns)
    none = documents.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, none, path).count() == 0


def test_components(spark):
    from factweave.llm.components import components

    rng = random.Random(7)
    for n, m in ((0, 0), (200, 90), (60, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(300, 340) if n]
        root = {x: x for e in edges for x in e}
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        out = components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted((r.node, r.root) for r in out) == sorted((x, root[x]) for x in linked)
