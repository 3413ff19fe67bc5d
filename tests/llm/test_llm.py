"""The text operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import hashlib
import io
import json
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import common, decontam, html_extract, jpeg, langid, neardup, packing, pii, quality, queries, simhash, toxicity, warc

D = "/root/testdata/sf0.001"
CLASH = {"fp": "x", "rep": 1, "k1": "y", "k2": 2, "score": 1.5, "accepted": "no", "_i": 3, "_t": 4, "h": 5, "w": 6, "item": 7, "media": 8, "payload": 9, "base": 10}
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One two three four five."), (4, "One two three four five."), (None, "one two three four five."), (5, "ÉÜß ñandú 日本語 \U0001f600 x"), (6, "word " * 30000), (7, "+1 (743) 555-3824 a.b@c.example.org 1.2.3.4, 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


EVERY = sorted((i is None, i or 0) for i, _ in ODD)


# SimHash


def brute_fingerprint(text, k=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, distance=2):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(fps)
    for n, a in enumerate(names):
        for b in names[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_against_brute_force(spark, docs):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.QUERIES["op1_simhash"](spark, D).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)


@pytest.mark.parametrize(("distance", "segments"), [(2, 8), (1, 4), (3, 16), (4, 16), (0, 4)])
def test_pigeonring_loses_no_link(spark, distance, segments):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b for b in base}
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    near = lambda apart: simhash.chain_holds(apart, 64 // segments, distance, segments)
    links = simhash.bucket_links(simhash.ring_keys(df, distance, segments), near)
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= distance for r in links.collect())
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = brute_components({signed(f): f for f in fps}, distance)
    assert {f: got.get(f, f) for f in want} == want


def test_a_large_group_of_near_copies_makes_few_links(spark):
    fps = sorted({(i * 0x9E3779B97F4A7C15) % (1 << 12) ^ (1 << 20) for i in range(3000)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.bucket_links(simhash.ring_keys(df), lambda apart: simhash.chain_holds(apart, 8, 2, 8))
    assert links.count() < 60 * len(fps)
    assert {r["root"] for r in simhash.components(links).collect()} == {fps[0]}


def test_skewed_joins(spark):
    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(200)], "i long, k long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m")).where("k <> 4")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table.drop("n"), "k", how).select("i", "k", "m").collect()))
        assert sorted(map(tuple, common.join_skewed(rows, table, "k", 3, how).select("i", "k", "m").collect())) == want


def test_least_hashed_rows(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("_i"), (F.col("id") % 7 == 0).cast("int").alias("g"))
    counts = {r[0]: r[1] for r in rows.groupBy("g").count().collect()}
    every = rows.withColumn("h", F.xxhash64("_i")).collect()
    want = {(r["_i"], r["g"]) for g in (0, 1) for r in sorted((r for r in every if r["g"] == g), key=lambda r: r["h"])[:40]}
    for spare in (4, 1, 0):  # with none to spare too few pass the threshold, and all are ranked
        assert {(r["_i"], r["g"]) for r in common.least_hashed(rows, "g", 40, counts, spare).collect()} == want


def test_components_of_chains_stars_and_none(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_defined_cases(spark, odd):
    got = simhash.near_duplicates(odd)
    assert ids(got) == EVERY
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert {c for _, c in by[None]} == {4} and len(by[4]) == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7]


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/ c", "<p>x</p>"), (2, None, None), (4, "u", ""), (5, "u", "é" * 3000), (5, "u", "é" * 3000), (None, "n", "only"), (None, "m", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in {"payload": 1, "sha1": 2, "first": 3}.items()})
    root = warc.write_archive(pages, f"file://{tmp_path}/a", roll_bytes=600, shard_bytes=3000)
    got = warc.read_archive(spark, root).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[1, "http://b/%20c"]["record_type"] == "response" and by[1, "http://b/%20c"]["payload"] == b"<p>x</p>"
    assert (by[3, "http://a/"]["record_type"], by[3, "http://a/"]["refers_to"], by[3, "http://a/"]["payload_bytes"], by[3, "http://a/"]["payload"]) == ("revisit", 1, 8, None)
    assert by[2, None]["record_type"] == "response" and by[4, "u"]["refers_to"] == 2
    assert [r["record_type"] for r in got if r["page_id"] == 5] == ["response", "response"]
    assert by[None, "m"]["refers_to"] == 1 and by[None, "n"]["record_type"] == "response"
    import base64

    assert by[1, "http://b/%20c"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert len(files) > 1 and not any(f.startswith("tmp-") for f in files)
    manifest = [json.loads(x) for p in (tmp_path / "a/manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert [m["file"] for m in manifest] == files
    for m in manifest:
        data = (tmp_path / "a" / m["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m["bytes"], m["sha256"])
    warc.write_archive(pages.repartition(3), f"file://{tmp_path}/b", roll_bytes=600, shard_bytes=3000)
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)


def test_warc_is_the_same_under_other_settings(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") * 37 % 40_009 - 500).alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    hot = spark.range(6000).select(F.lit(77).cast("long").alias("page_id"), F.concat(F.lit("u"), F.col("id")).alias("url"), F.col("id").cast("string").alias("html"))
    pages = rows.unionByName(hot)
    found = []
    for n, name in ((4, "a"), (7, "b")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        root = warc.write_archive(pages.repartition(n), f"file://{tmp_path}/{name}", roll_bytes=300_000, shard_bytes=1 << 20)
        found.append(sorted((r["file"], r["sha256"], r["records"]) for r in spark.read.json(f"{root}/manifest").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] and len(found[0]) > 20 and sum(r for *_, r in found[0]) == 46_000 and max(r for *_, r in found[0]) < 4000
    assert warc.read_archive(spark, root, False).select("page_id", "payload_digest").distinct().count() == 46_000


def test_warc_reads_what_its_manifest_names(spark, tmp_path):
    pages = lambda n: spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("html"))
    root = warc.write_archive(pages(50), f"file://{tmp_path}/a", roll_bytes=2000)
    many = [f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    (tmp_path / "a" / "tmp-9-part-000000-000000.warc.gz").write_bytes(b"lost attempt")
    (tmp_path / "a" / "part-000009-000000.warc.gz").write_bytes(b"of another run")
    assert warc.read_archive(spark, root).count() == 50
    warc.write_archive(pages(20), root, roll_bytes=2000)  # a restart into the same root replaces what is there
    left = [f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    assert warc.read_archive(spark, root).count() == 20 and len(left) < len(many) and not any(f.startswith("tmp-") for f in left)
    (tmp_path / "a" / left[0]).write_bytes((tmp_path / "a" / left[0]).read_bytes()[:-20])
    with pytest.raises(Exception, match="cut off|manifest"):
        warc.read_archive(spark, root).count()
    os.remove(tmp_path / "a/manifest/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        warc.read_archive(spark, root)


def test_shard_bounds_of_clustered_ids(spark):
    ids = [-5, 10**15, *range(10**9, 10**9 + 300), -(1 << 62), 1 << 62]
    rows = spark.createDataFrame([(i, i % 1000, 1000) for i in ids], "page_id long, h long, size long")
    bounds = warc.shard_bounds(rows, 20_000)
    counts = rows.withColumn("s", warc.shard_of(bounds)(F.col("page_id"), F.col("h"))).groupBy("s").count().collect()
    assert bounds == sorted(bounds) and max(r["count"] for r in counts) <= 20 and len(counts) <= 2 * len(ids) // 20


def test_warc_of_no_pages(spark, tmp_path):
    root = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, root).count() == 0


def test_warc_finds_damage():
    data = warc._member(warc.record(1, "u", b"abc", "D", 3, None), 6)
    assert [b[-3:] for _, b in warc.parse(io.BytesIO(data * 3).read, 7)] == [b"abc"] * 3
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse(io.BytesIO(data[:-9]).read))


def test_joins_beyond_broadcasts(spark, tmp_path, monkeypatch):
    rows = spark.read.parquet(f"{D}/documents.parquet")
    pages = rows.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("doc_id") % 3 == 0, "same").otherwise(F.col("text")).alias("html"))
    results = []
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        kept = sorted(r["doc_id"] for r in simhash.one_of_each(rows).collect())
        root = warc.write_archive(pages, f"file://{tmp_path}/{most}")
        results.append((kept, sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, root, False).drop("payload").collect())))
    assert results[0] == results[1] and len(results[0][0]) < rows.count()


# HTML

ARTICLE = "<p>This is the first paragraph of the article and it has a lot of words in it, so that it is long enough to be judged on its own by the rules that are here.</p><p>Short one.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a<p>b &amp;amp; c", "a\n\nb &amp; c"),
        ("<p> x\n\t y<br>z &nbsp;w </p>", "x y z w"),
        ("<nav><ul><li>Home</li></ul></nav><article><h1>T</h1>" + ARTICLE + "</article><footer>f</footer>", "T\n\n{A}\n\nShort one."),
        ("<div class='cookie-notice'>We use the cookies of the site for all of it.</div><div id=content>" + ARTICLE + "</div><div class=comments><p>It is the best of all that I have read in the last year and it was good.</p></div>", "{A}\n\nShort one."),
        ("<article>" + ARTICLE + "<script>var t='</p>';</script><style>p{}</style><!-- c --><form>Name <input></form><aside>More of it</aside>", "{A}\n\nShort one."),
        ("<article><p>cut <b>off", "cut off"),
        ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_main_text(page, text):
    first = re.search("<p>(.*?)</p>", ARTICLE)[1]
    assert html_extract.extract(page) == text.replace("{A}", first)


LONG = {
    "en": re.search("<p>(.*?)</p>", ARTICLE)[1],
    "it": "Questo è il primo paragrafo dell'articolo e contiene molte parole, in modo che sia abbastanza lungo da essere giudicato da solo dalle regole che sono qui scritte.",
    "pl": "Pierwszy akapit artykułu zawiera wiele wyrazów, dzięki czemu jest wystarczająco długi, żeby reguły mogły ocenić akapit samodzielnie oraz bez pomocy sąsiadów tekstu.",
    "ru": "Это первый абзац статьи, и в нем много слов, так что он достаточно длинный, чтобы его можно было оценить отдельно по правилам, которые здесь записаны для всех.",
    "ja": "これは記事の最初の段落であり、多くの言葉が含まれているため、ここにある規則によって単独で判断するのに十分な長さがあります。二番目の文もあります。",
}


@pytest.mark.parametrize("lang", LONG)
@pytest.mark.parametrize("shell", ["<div class='layout has-sidebar'>{}</div>", "<div id='search-results-article'>{}</div>", "{}", "<form id=aspnetForm>{}</form>", "<div class=sidebar><main>{}</main></div>", "<article>{}</article>"])
def test_articles_survive_names_and_languages(lang, shell):
    body = f"<p>{LONG[lang]}</p><p>Kurz.</p><p>{LONG[lang]}</p>"
    around = "<nav><a href=/>Home</a></nav>{}<div class='cookie-notice'>" + LONG["en"] + "</div><footer>x</footer>"
    assert html_extract.extract(around.format(shell.format(body))) == f"{LONG[lang]}\n\nKurz.\n\n{LONG[lang]}"


def test_density_rules_decide_without_an_article():
    links = "".join(f"<li><a href=/{i}>A headline about something that has happened {i}</a></li>" for i in range(5))
    code = "<p>" + " ".join(f"qx{i} zz{i}" for i in range(40)) + "</p>"
    page = f"<div><ul>{links}</ul></div><div><p>{LONG['en']}</p><p>By N. N.</p></div><div>{code}</div><div><ul>{links}</ul><p>More</p></div>"
    assert html_extract.extract(page) == f"{LONG['en']}\n\nBy N. N."


def test_parts_within_an_article():
    inner = f"<p>{LONG['en']}<span class='ad'>x<span>y</span> leak</span></p><p><a href=x>See the whole report that was published here last week</a></p><p>{LONG['en']}</p>"
    rest = "<ul><li><a href=1>One more story that you may want to read</a></li><li><a href=2>Two</a></li></ul><section class=comments><article class=comment><p>" + LONG["en"] + "</p></article></section>"
    assert html_extract.extract(f"<article>{inner}{rest}</article>") == f"{LONG['en']}\n\nSee the whole report that was published here last week\n\n{LONG['en']}"
    assert not html_extract.named('class="has-sidebar"') and html_extract.named('class="x adSlot"') and html_extract.named("id=related-posts")


def test_pages_of_the_tables_give_their_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    for r in queries.QUERIES["op3_html"](spark, D).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_html_defined_cases(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html_extract.main_text(df.limit(0)).count() == 0


# JPEG


@pytest.mark.parametrize("units", [1, 2, 3, 7, 64, 500])
def test_jpeg_round_trip(units):
    payload = random.Random(units).randbytes(192 * units)
    image = jpeg.decode([jpeg.encode(payload)])[0]
    assert jpeg.payload_of(image) == payload
    columns, rows = jpeg.grid(units)
    assert (image["width"], image["height"]) == (8 * columns, 8 * rows) and image["thumbnail"].shape == (rows, columns)
    first = payload[0] if payload[0] >= 128 else payload[0] - 255
    assert image["thumbnail"][0, 0] == min(255, max(0, (first * 4 + 4) // 8 + 128))


def test_jpeg_with_other_tables_and_without_restarts():
    """A grey 16 x 8 image: DC differences 3 and -2, one AC coefficient after a run of two zeros in the second block."""
    bits = "10" + "11" + "0" + "10" + "01" + "10" + "1" + "0"  # DC size 2, value 3, end; DC size 2, value -2, run 2 size 1, value 1, end
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes([16] + [1] * 63)) + jpeg._segment(0xC0, bytes((8, 0, 8, 0, 16, 1, 1, 0x11, 0)))
    data += jpeg._huffman(0, 0, {2: [0, 1, 2]}) + jpeg._huffman(1, 0, {1: [0x00], 2: [0x21]}) + jpeg._segment(0xDA, bytes((1, 1, 0, 0, 63, 0))) + scan + b"\xff\xd9"
    image = jpeg.decode([data])[0]
    assert image["coefficients"][:, 0, 0].tolist() == [3, 1] and image["coefficients"][1, 0, 3] == 1
    assert image["thumbnail"].tolist() == [[134, 130]]
    with pytest.raises(ValueError, match="JPEG"):
        jpeg.decode([b"\xff\xd8\xff"])


def test_media_columns(spark, odd):
    got = jpeg.media_features(jpeg.to_media(odd)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == EVERY
    for r in got:
        for text in (t for i, t in ODD if i == r["doc_id"]):
            raw = (text or "").encode()
            padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert jpeg.media_features(jpeg.to_media(odd.limit(0))).count() == 0


# Toxicity and quality


def made_texts(n, mark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        y = i % 3 == 0
        out.append((i, mark(text, y, rng), int(y)))
    return out


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_hold_out(spark, kind):
    def mark(words, y, rng):
        if kind == "toxic" and y:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zzmoron", "zzidiots", "qqscum"]))
        if kind == "quality" and not y:
            words = [w.upper() + "!!" for w in words]
        return " ".join(words)

    rows = made_texts(300, mark, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {kind} int")
    module, run = (toxicity, toxicity.score_toxicity) if kind == "toxic" else (quality, quality.score_quality)
    got = {r["doc_id"]: r for r in run(docs, module.train(docs, labels)).collect()}
    held = [(got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert auc(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_defined_cases(spark, odd, module):
    run = toxicity.score_toxicity if module is toxicity else quality.score_quality
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    share = module.train(odd, none)
    assert share == (0.0 if module is toxicity else 0.5)
    assert ids(run(odd, share)) == EVERY
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = run(odd, module.train(odd, labels))
    assert ids(got) == EVERY and all(0 <= r["score"] <= 1 for r in got.collect())
    assert run(odd.limit(0), share).count() == 0


@pytest.mark.parametrize("name", ["op5_toxicity", "op8_quality"])
def test_classifiers_on_the_labels(spark, name):
    d = D.replace("0.001", "0.01")
    label, cut = ("toxic", 0.5) if name == "op5_toxicity" else ("quality", 0.3)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, d).collect()}
    assert all(r["predicted"] == (r["score"] >= cut) for r in got.values())
    held = [(got[i]["score"], y) for i, y in truth.items() if got[i]["held_out"] and y is not None]
    # 400 labels here: the lexicon of the toxicity model is small (0.997 at ten times as many)
    assert len(held) > 50 and auc(held) > (0.85 if label == "toxic" else 0.97)
    assert sum((s >= cut) == bool(y) for s, y in held) >= 0.9 * len(held)


def test_quality_against_brute_force():
    import numpy as np
    import xxhash

    rng = random.Random(2)
    words = ["Foo", "BAR!!", "x1-2", "the", "the", "été", "...", "a" * 60 + "1B" * 20, "a" * 60 + "1B" * 21]
    texts = ["", "  \n ", "one", *(" ".join(rng.choice(words) + rng.choice(["", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    digest, top = xxhash.xxh64_intdigest, (1 << 64) - 1

    def brute(text):
        ws, out = text.split(), []
        word = [digest(re.sub(r"[\W\d_]+", "", w).lower(), 1) for w in ws]
        shape = [digest(quality.shape_of(w), 2) for w in ws]
        shape = [s ^ 0x9E3779B97F4A7C15 if i and word[i] == word[i - 1] else s for i, s in enumerate(shape)]
        mix = 0xFF51AFD7ED558CCD
        out += word + [a * mix + b for a, b in zip(word, word[1:])] + shape
        out += [(a * mix + b) * mix + 1 for a, b in zip(shape, shape[1:])]
        out += [((a * mix + b) & top) * mix + c + 2 for a, b, c in zip(shape, shape[1:], shape[2:])]
        lines = [x for x in text.split("\n") if x.strip()]
        whole = [f"length {len(ws).bit_length()}"]
        if lines:
            whole += [f"lines {4 * (len(lines) - len(set(lines))) // len(lines)} {min(len(lines).bit_length(), 3)}", f"different {8 * len(set(ws)) // len(ws)} {min(len(ws).bit_length(), 8)}"]
        out += [digest(x, 3) for x in whole] * max(1, len(ws) // 4)
        mixed = []
        for h in out:
            h &= top
            mixed.append(((h ^ (h >> 31)) * 0xC4CEB9FE1A85EC53 & top) >> 44)
        return sorted(mixed)

    features, model = quality.Features(most=20), quality.Regression()
    model.fit([features.of(t) for t in texts], [i % 2 for i in range(len(texts))], [1.0] * len(texts))
    model.freeze()
    for at in range(0, len(texts), 13):
        part = texts[at : at + 13]
        index, owner = features.indices(part)
        assert [sorted(index[owner == i].tolist()) for i in range(len(part))] == [brute(t) for t in part]
        want = [1 / (1 + np.exp(-(quality.SCALE * np.mean([float(model.w[j]) for j in brute(t)]) + model.bias))) for t in part]
        assert np.allclose(model.score(part, features), want)
    assert quality.shape_of(words[-1]) != quality.shape_of(words[-2])


def test_trees_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = toxicity.Trees(rounds=5).fit(x, y, np.ones(300))
    for row, margin in zip(x, trees.margin(x)):
        total = trees.start
        for levels, leaves in trees.trees:
            node = 0
            for splits in levels:
                f, j = splits[node]
                bin_ = sum(c <= row[f] for c in trees.cuts[f])
                node = 2 * node + int(bin_ > j)
            total += leaves[node]
        assert abs(total - margin) < 1e-9
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.8


def test_isotonic_fit():
    import numpy as np

    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


# Personal data


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_base_spans_against_patterns(docs):
    for t in docs.values():
        assert pii.rendered(pii.base_spans(t)) == brute_spans(t)
    rng = random.Random(3)
    for alphabet in ("ab.@-1 ", "0125.", "+4 1-()", "4 1-"):
        for _ in range(2000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.rendered(pii.base_spans(t)) == brute_spans(t), t


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{D}/documents.parquet"))


def test_tagger_adds_and_keeps(docs, tagger):
    texts = ["call (743) 555-3824 today or the day after", "in 2024 it was 3.14 of 100", "mail a.b@c.example.org now"]
    base = [pii.base_spans(t) for t in texts]
    added = tagger.added(texts, base)
    assert [texts[0][a:b] for a, b, _ in added[0]] == ["(743) 555-3824"] and added[1:] == [[], []]
    all_ = list(docs.values())
    extra = tagger.added(all_, [pii.base_spans(t) for t in all_])
    assert sum(map(len, extra)) <= len(all_) // 50


def test_tagger_gradient():
    import numpy as np

    tagger = pii.Tagger(hidden=3, window=5)
    x, y = np.array([[0, 1, 2, 3, 4], [5, 4, 3, 2, 1]]).T, np.array([[0, 1, 2, 0, 3], [0, 0, 1, 0, 0]]).T
    e, both, kf, kb = tagger.emissions(x)
    loss, ge, gt = tagger._crf(e, y)
    grads = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    gb = ge @ tagger.p["o"].T
    tagger._back(x, "f", kf, gb[:, :, :3], grads)
    tagger._back(x, "b", kb, gb[:, :, 3:], grads)
    grads["t"] = gt
    for name in ("xf", "hf", "cb", "t"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        tagger.p[name][at] += 1e-5
        up = tagger._crf(tagger.emissions(x)[0], y)[0]
        tagger.p[name][at] -= 1e-5
        assert abs((up - loss) / 1e-5 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def test_tagger_recall_on_written_spans(docs, tagger):
    """Spans that no pattern matches, in texts of the tables that the tagger didn't see; windows made by another seed than the training's."""
    spaced = [t for i, t in sorted(docs.items()) if not pii.TRIGGER.search(t) and len(t) > 300]
    rng = random.Random(99)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    found = total = 0
    for t in spaced:
        at = t.index(" ", rng.randrange(100, 200))
        span = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"jane{digits(2)} at example dot com", f"bob (at) mail{digits(1)}.example (dot) org"])
        text = f"{t[:at]} {span}{t[at:]}"
        base = pii.base_spans(text)
        added = tagger.added([text], [base])[0]
        total += 1
        found += any((a, b) == (at + 1, at + 1 + len(span)) for a, b, _ in [*base, *added])
    assert total > 50 and found >= 0.9 * total


def test_base_spans_of_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    assert pii.base_spans("1" * 1_000_000) == [] and len(pii.base_spans("1." * 200_000)) == 50_000 and pii.base_spans("+1 " * 100_000) == []
    assert time.perf_counter() - began < 5


def test_pii_defined_cases(odd, tagger):
    rows = odd.select("doc_id", "text", F.lit(1).alias("fp"))
    got = pii.find_spans(rows, tagger).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == EVERY
    assert {s["kind"] for r in got if r["doc_id"] == 7 for s in r["base"]} == {"phone", "email", "ip", "card"}
    masked = pii.masked(odd, tagger)
    text = next(r["text"] for r in masked.collect() if r["doc_id"] == 7)
    assert text == "[PHONE] [EMAIL] [IP], [CARD]" and masked.columns == odd.columns
    assert pii.find_spans(rows.limit(0), None).count() == 0 and pii.masked(odd.limit(0), None).count() == 0


@pytest.mark.parametrize("address", ["jane at example dot com", "JANE AT EXAMPLE DOT COM", "jane (AT) example.org", "jane[At]example.org", "jane( at )example.org", "jane.doe (at) mail.example (dot) org", "jane(at)informatik.uni-wuerzburg.de", "maximiliane.elisabeth.von-und-zu-hohenstein-langenberg(at)example.org"])
def test_pii_addresses_in_words_and_long_ones_are_whole(spark, tagger, address):
    text = f"please write to {address}, or stay at home. Then call."
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s["start"], s["end"], s["kind"]) for s in pii.find_spans(rows, tagger).first()["spans"]]
    assert spans == [(16, 16 + len(address), "email")]
    assert pii.masked(rows, tagger).first()["text"] == "please write to [EMAIL], or stay at home. Then call."


# Language


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = queries.QUERIES["op7_langid"](spark, D).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["accepted"] for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_kneser_ney_against_brute_force():
    """Interpolated Kneser-Ney by its definition, from raw counts, word by word."""
    import math
    from collections import Counter

    samples = {"a": ["abba baab aab", "bab"], "b": ["cdc dcd ccd"]}
    models = langid.Models(samples, order=3, discount=0.75)
    alphabet = len(set("abcd") | {langid.EDGE})
    for column, lang in enumerate(models.langs):
        marked = [langid.EDGE + w + langid.EDGE for t in samples[lang] for w in t.split()]
        raw = [Counter(w[at - k + 1 : at + 1] for w in marked for at in range(1, len(w)) if at - k + 1 >= 0) for k in range(4)]
        counts = [None, Counter(), Counter(), raw[3]]
        for k in (1, 2):  # lower orders count distinct left neighbours; nothing stands before a word's first mark
            counts[k].update(g[1:] for g in raw[k + 1])
            counts[k].update({g: n - counts[k][g] for g, n in raw[k].items() if g[0] == langid.EDGE})

        def p(g):
            if not g:
                return 1 / (4 * alphabet)
            own = {x: n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]}
            if not own:
                return p(g[1:])
            total = sum(own.values())
            return max(own.get(g, 0) - 0.75, 0) / total + 0.75 * len(own) / total * p(g[1:])

        for word in ("abba", "dcd", "a", "cab", "zz"):
            w = langid.EDGE + word + langid.EDGE
            want = sum(math.log(p(w[max(0, at - 2) : at + 1])) for at in range(1, len(w)))
            assert abs(models.words([word])[0][column] - want) < 1e-3, (lang, word)
    got = models.predict(["abba", "dcd", "", None, "123"], {})
    assert got[0] == ["a", "b", "und", "und", "und"] and not got[3][2:].any()


def test_language_defined_cases(spark, odd):
    models = langid.train(odd)
    got = langid.identify(odd.select("doc_id", "text"), models)
    assert ids(got) == EVERY
    assert {r["lang_pred"] for r in got.where("doc_id IN (1, 2, 3)").collect()} == {"und"}
    none = langid.train(odd.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.identify(odd.select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.accepted(odd, models).columns == odd.columns and langid.accepted(odd.limit(0), models).count() == 0


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rng = random.Random(1)
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), " ".join("".join(rng.choice("qxzjkwv") for _ in range(9)) for _ in range(60))]
    assert langid.train(docs).predict(noise, {})[3].tolist() == [False, False]


# Decontamination


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        out.append((i is None, i or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "É", "é", "x1", "日本"])
    items = [(i, rng.choice([" ", ", ", "_"]).join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 30])))) for i in range(12)] + [(50, None), (2, "a a a a a a a a a a a a")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 4, 9, 10, 60])))) for i in range(20)]
    docs += [(100 + i, "lead " + (t or "").upper() + " tail " + (t or "")) for i, t in items] + [(None, items[3][1]), (1, None), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = decontam.contamination(df, bench).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == brute_hits(docs, items)
    clean = decontam.without_contaminated(df, bench)
    left = [(i, t) for i, t in docs if not brute_hits([(i, t)], items)[0][3]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert clean.columns == df.columns and sorted(map(key, clean.select("doc_id", "text").collect())) == sorted(map(key, left))


def test_decontamination_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    got = queries.QUERIES["op9_decontam"](spark, D).collect()
    assert sorted((False, r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == brute_hits(docs, items)


def test_decontamination_of_repeats(spark):
    docs = [(1, "a " * 5000), (2, "b " + "a " * 11 + "c"), (3, "a b " * 400)]
    items = [(1, "a " * 12), (2, "b a " * 20), (3, "a a a")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((False, r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ids(decontam.contamination(odd, bench)) == EVERY
    assert decontam.contamination(odd.limit(0), bench).count() == 0
    assert decontam.without_contaminated(odd, bench).count() == len(ODD)


# Packing


def check_packing(got, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    import numpy as np

    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    for i, text in texts:
        ids_ = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(1 for j, _ in texts if j == i)
        rows = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in rows) == copies * len(ids_)
        for r in rows:
            assert r["doc_tokens"] == len(ids_) and r["ids_crc32"] == zlib.crc32(ids_[r["start"] : r["start"] + r["length"]].tobytes())
    lengths = [sum(r["length"] for r in rows) for rows in by_sequence.values()]
    return sum(1024 - n for n in lengths if n & (n - 1)) / sum(lengths)


def test_packing(spark, docs):
    assert check_packing(queries.QUERIES["op10_packing"](spark, D).collect(), list(docs.items())) < 0.01


def test_packing_defined_cases(spark, odd):
    check_packing(packing.harmonic_pack(odd).collect(), ODD)
    special = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|>y z <|endoftext")]
    check_packing(packing.harmonic_pack(spark.createDataFrame(special, "doc_id long, text string")).collect(), special)
    assert packing.harmonic_pack(odd.limit(0)).count() == 0


def test_word_cache_gives_the_same_ids():
    encoder = packing.Encoder(packing.default_tokenizer(), most=50)
    assert encoder.merges is not None
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab '\n\t  é1,.日s<|endoftext|>") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for at in range(0, 3000, 100):
        assert encoder.encode(texts[at : at + 100]) == encoder.whole(texts[at : at + 100])


def test_other_tokenizers_go_through_the_tokenizer(spark, tmp_path):
    spec = json.load(open(packing.default_tokenizer(), encoding="utf-8"))
    for n, change in enumerate([{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}}]):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        encoder = packing.Encoder(str(path))
        assert encoder.merges is None
        texts = ["Hello World 1234 and so on", "one two", "x <|endoftext|> Y"]
        assert encoder.encode(texts) == encoder.whole(texts)


# Pipeline


def test_pipeline_against_brute_force(spark, docs):
    rows = spark.read.parquet(f"{D}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    names = rows.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, rows, D)
    assert kept.columns == names and {r["doc_id"] for r in kept.collect()} == set(docs)
    once = {r["doc_id"] for r in stages["near_duplicates"](spark, kept, D).collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    assert once <= set(first.values()) and len(once) >= 0.9 * len(first)
    clean = stages["decontamination"](spark, rows.where(F.col("doc_id").isin(*once)), D)
    assert {r["doc_id"] for r in clean.collect()} == {i for _, i, _, n, *_ in brute_hits([(i, docs[i]) for i in once], items) if not n}
    masked = stages["personal_data"](spark, clean, D)
    assert masked.columns == names
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        if not pii.TRIGGER.search(docs[r["doc_id"]]):
            assert r["text"] == docs[r["doc_id"]]
    check_packing(stages["packing"](spark, masked, D).collect(), [(r["doc_id"], r["text"]) for r in masked.collect()])


def test_pipeline_run_removes_what_it_needs_no_more(spark):
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    result = corpus_pipeline.run(spark, D)
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
    assert result.count() > 0 and {x.partition("-")[0] for x in left} == {"packing"}


def test_pipeline_stages_take_odd_rows(spark, odd):
    rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, D)
        assert rows.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, D).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), D).count() == 0


def brute_jaccard(texts, k=5):
    """The smallest id of each text's component over pairs at a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[n : n + k]) for n in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[:n]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    texts = {}
    for group in range(60):  # chains of copies: each replaces a run of words of the one before it
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, 9)):
            texts[len(texts)] = " ".join(words)
            for at in rng.sample(range(len(words)), rng.randrange(1, 1 + len(words) // 40)):
                words[at] = f"w{rng.randrange(10**6)}"
    for cut in range(9, 16):  # nested texts, similar to 4/5 exactly and a little less
        texts[len(texts)] = " ".join(f"n{k}" for k in range(cut))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    want = brute_jaccard(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert all(want[i] == want[c] and c <= i for i, c in got.items())  # no link that isn't one
    sets = {i: {tuple(t.split()[n : n + 5]) for n in range(len(t.split()) - 4)} for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and want[a] == want[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(set(want.values())) < len(texts) - 100 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, df, D).collect()} == set(got.values())


def test_near_duplicate_recall_at_the_threshold():
    """Pairs of sets at a similarity of just 0.8 and more: how many share a chain that stays within its budgets."""
    import numpy as np

    rng, votes = np.random.default_rng(4), neardup.signs()
    for similarity, least in ((0.8, 0.93), (0.85, 0.98), (0.9, 0.99)):
        sides = ([], [])
        for _ in range(600):
            common_ = rng.integers(0, 1 << 63, int(np.ceil(600 * similarity / (1 + similarity))), dtype=np.uint64)
            for side in sides:
                side.append(np.concatenate([common_, rng.integers(0, 1 << 63, 300 - len(common_), dtype=np.uint64)]))
        a, b = (neardup.wide_fingerprints(side, votes).view("<i8") for side in sides)
        found = np.zeros(600, bool)
        for (_, ka, ta), (_, kb, tb) in zip(neardup.chains(a), neardup.chains(b)):
            apart = (ta ^ tb).view(np.uint64)
            holds = ka == kb
            for n in range(1, 9):
                holds &= np.bitwise_count(apart & np.uint64((1 << 8 * n) - 1)) <= (neardup.EQUAL + n) * neardup.DISTANCE // neardup.SEGMENTS
            found |= holds
        found &= np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1) <= neardup.DISTANCE
        assert found.mean() >= least, (similarity, found.mean())


def nearly_similar(number, seed=5):
    """Texts made from one of 240 words, each with one to six others in places of its own: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(240)], {}
    for i in range(number):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 7)):
            words[at] = f"w{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    return texts


def test_near_duplicate_pairs_of_a_group_are_not_rows(spark):
    """What joins, explodes and groups of the stage make, by name, over a group of nearly similar texts."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    texts = nearly_similar(600)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    assert neardup.near_duplicates(df).count() == len(texts)
    made = {}
    for at in range(store.executionsList().size()):
        run = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size() if run not in seen else 0)):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if re.search("Join|Generate|GroupsInArrow", node.name()) and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    name = re.sub(r"#\d+L?", "", node.desc())[:60]
                    made[name] = made.get(name, 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    # a text asks for its family once for each of its 210 buckets
    most = {k: n for k, n in made.items() if n > len(texts) * (210 if "[node], [node], LeftOuter" in k else 40)}
    assert made and not most, most


@pytest.mark.parametrize("block, blocks, shingles", [(1 << 20, 16, 1 << 20), (16, 16, 1 << 20), (16, 2, 700)])
def test_near_duplicates_of_a_group_in_blocks(spark, monkeypatch, block, blocks, shingles):
    texts = nearly_similar(160)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCKS", blocks)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    want = brute_jaccard(texts)
    assert 1 < len(set(want.values())) < len(texts) - 10
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_families_are_merged_over_every_chain_of_a_bucket(rows):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(rows)
    k = np.sort(rng.integers(0, 12, 400))
    bits = rng.integers(0, 4, 400) << rng.integers(0, 62, 400) | np.array([0, -1])[rng.integers(0, 2, 400)]  # near 0, and all ones
    family = rng.integers(0, 300, 400)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + rows]) for c in (k, bits, family)], names=["k", "bits", "family"]) for i in range(0, 400, rows)]
    got = [p for b in neardup._merge_batches(iter(batches)) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]

    def parts(pairs):
        root = list(range(300))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i in range(300) if root[i] == r) for r in root}

    def holds(x):
        return all(((x % (1 << 64)) & ((1 << 8 * n) - 1)).bit_count() <= (neardup.EQUAL + n) * neardup.DISTANCE // neardup.SEGMENTS for n in range(1, 9))

    pairs = [(int(family[i]), int(family[j])) for i in range(400) for j in range(i) if k[i] == k[j] and holds(int(bits[i]) ^ int(bits[j]))]
    assert len(parts(pairs)) > 5 and parts(got) == parts(pairs) and len(got) == 300 - len(parts(got))
