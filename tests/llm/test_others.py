import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat.llm import jpeg, queries, rule_classifier
from arborstat.llm.rule_classifier import STATISTICS, RuleModel, fit, held_out, score_documents, statistics, train
from arborstat.llm.sharding import shard_by_bytes
from arborstat.llm.url_filter import host_suffix, judge_urls, registered_domain

from .common import frame, odd_rows, repeated_rows

SF = "/root/testdata/sf0.001"


def test_url_rules_and_parts(spark):
    urls = [
        (1, "https://A.Example.COM/en/7/x?q#f"), (2, "http://b.net/de/9"), (3, "http://example.net/de/88"), (4, "ftp://x.org/es/"), (5, "http://notcom/en/"), (6, None), (7, "no host"), (8, "http://h.com"), (9, "http://com/en/a://b"),
        (10, ""), (None, "http://q.org/es/1"), (1, "https://A.Example.COM/en/7/x?q#f"), (11, "http://u\nv.com/en/\nz?"),
    ]
    pages = spark.createDataFrame([(*u, "clash", 1.0) for u in urls], "page_id long, url string, host string, bound double")
    outcomes = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "page_id long, good int")
    got = judge_urls(pages, outcomes, queries.RULES).collect()
    assert len(got) == len(urls)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert (by[2].rule, by[3].rule, by[4].rule, by[5].rule) == ("net/de/", "example.net/de/8", "org/es/", None)
    assert (by[6].host, by[6].path, by[7].host, by[8].path, by[9].rule, by[11].path) == ("", "", "", "", "com/en/", "/en/\nz")
    assert judge_urls(pages.limit(0), outcomes, queries.RULES).count() == 0
    assert judge_urls(pages, outcomes.limit(0), queries.RULES).count() == len(urls)


def test_suffixes_of_one_and_two_labels(spark):
    hosts = {"a.b.co.kr": ("co.kr", "b.co.kr"), "x.gov.au": ("gov.au", "x.gov.au"), "co.uk": ("co.uk", "co.uk"), "a.b.com": ("com", "b.com"), "co.com": ("com", "co.com"), "s.github.io": ("io", "github.io"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.s, r.d) for r in df.select("h", host_suffix(F.col("h")).alias("s"), registered_domain(F.col("h")).alias("d")).collect()}
    assert got == hosts
    more = df.select(host_suffix(F.col("h"), ["github.io"]).alias("s"), registered_domain(F.col("h"), ["github.io"]).alias("d")).where("s = 'github.io'").collect()
    assert [tuple(r) for r in more] == [("github.io", "s.github.io")]


def test_reputation_shrinks_towards_parents(spark):
    pages = [(k, f"http://good{k % 5}.fine.com/{k}") for k in range(200)] + [(1000 + k, f"http://bad.awful.com/{k}") for k in range(100)] + [(2000, "http://new.awful.com/"), (2001, "http://new.fine.com/")]
    outcomes = [(k, int(k % 20 != 0)) for k in range(200)] + [(1000 + k, int(k % 10 == 0)) for k in range(100)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"), []).collect()}
    assert got[1000].verdict == "block" and got[0].verdict == "allow"
    assert got[2000].bound < got[2001].bound  # a host without outcomes is judged by its domain


def model_of(n=600):
    rng = np.random.default_rng(0)
    x = rng.random((n, len(STATISTICS)))
    return x, ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)


def test_rules_are_learnt_and_compiled(spark):
    x, y = model_of()
    model = fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 150
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x[:100])], "k long, " + ", ".join(f"{s} double" for s in STATISTICS))
    got = [r.s for r in df.select("k", model.column().alias("s")).orderBy("k").collect()]
    assert np.allclose(got, model.score(x[:100]))


def test_first_split_is_the_best_of_all():
    """Against every bound of every statistic, tried one by one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).round(1)
    g, h = rng.normal(size=120), rng.uniform(0.1, 0.3, 120)
    edges = [np.unique(x[:, f])[:-1] for f in range(4)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(4)], axis=1)
    rules, step = [], np.zeros(120)
    rule_classifier.grow(binned, g, h, np.arange(120), np.arange(4), edges, 5, 1, (), rules, step)
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, f] <= v, x[:, f] > v)), f, v) for f in range(4) for v in edges[f] if 5 <= (x[:, f] <= v).sum() <= 115)
    assert {r[0][:1] + r[0][2:] for r in rules} == {best[1:]}
    for m in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
        assert np.allclose(step[m], g[m].sum() / (h[m].sum() + 1))


def test_lasso_weights_are_the_best():
    """No weight can be moved alone so that penalised loss falls: tried on a grid about each weight."""
    rng = np.random.default_rng(4)
    a = rng.random((300, 8)) < 0.4
    y = (a[:, 0] | (a[:, 1] & a[:, 2])).astype(float)
    a = a.astype(float)
    w, c = np.zeros(8), 0.0
    for _ in range(10):
        w, c = rule_classifier.lasso(a, y, 0.01, w, c)

    def loss(w, c):
        z = a @ w + c
        return np.mean(np.logaddexp(0, z) - y * z) + 0.01 * np.abs(w).sum()

    held = loss(w, c)
    for j in range(8):
        for d in (-0.5, -0.05, -0.005, 0.005, 0.05, 0.5):
            moved = w.copy()
            moved[j] += d
            assert loss(moved, c) >= held - 1e-7
    assert loss(w, c + 0.01) >= held - 1e-7 and loss(w, c - 0.01) >= held - 1e-7 and (np.abs(w[3:]) < 0.3).all()


def test_models_without_two_kinds():
    assert fit(np.zeros((0, len(STATISTICS))), np.zeros(0)).score(np.zeros((2, len(STATISTICS)))).tolist() == [0.5, 0.5]
    assert fit(np.zeros((3, len(STATISTICS))), np.ones(3)).rules == ()


@pytest.mark.parametrize("rows", [odd_rows(), repeated_rows(), []])
def test_scores_of_odd_rows(spark, rows):
    x, y = model_of(100)
    got = score_documents(frame(spark, rows), fit(x, y)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(statistics(None)) == len(STATISTICS) and set(statistics("")) == {0.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_documents(docs, train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(docs, labels) == train(docs, turned)
    assert isinstance(train(docs, labels.limit(0)), RuleModel)


@pytest.mark.parametrize("rows", [odd_rows(), repeated_rows(), []])
def test_sharding(spark, rows):
    got = shard_by_bytes(frame(spark, rows), 3).collect()
    assert len(got) == len(rows)
    sizes = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, before, want, slots = sum(s[2] for s in sizes), 0, [], [0, 0, 0]
    for has, doc, size, crc in sizes:
        shard = min(2, (2 * before + size) * 3 // (2 * total))
        want.append((doc if has else None, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_jpeg_round_trip_and_thumbnail():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 7, 40)] + [b"\xff" * 192 * 3, b"\0" * 192]
    streams = jpeg.encode_payloads(payloads, [len(p) for p in payloads])
    for image, payload in zip(jpeg.decode_images(streams), payloads, strict=True):
        assert jpeg.stored_payload(image) == (payload, len(payload))
        thumb = image.thumbnail()
        assert thumb.shape == (image.height // 8, image.width // 8)
        dc = int(image.blocks[0][0, 0])
        assert thumb[0, 0] == round(dc / 8 + 128)


def bits_of(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def test_jpeg_of_another_encoder():
    """Subsampled chroma, own code tables of many lengths, differential DC, runs, a restart interval of two MCUs."""
    rng = np.random.default_rng(2)
    dc_symbols, ac_symbols = bytes(range(12)), bytes([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 8))])
    table = lambda symbols: bytes([0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, len(symbols) - 6]) + symbols

    def codes(spec):
        out, code, at = {}, 0, 16
        for length in range(1, 17):
            for symbol in spec[at : at + spec[length - 1]]:
                out[symbol] = format(code, f"0{length}b")
                code += 1
            at, code = at + spec[length - 1], code << 1
        return out

    dc, ac = table(dc_symbols), table(ac_symbols)
    wide, high = 40, 24  # 3 x 2 MCUs of 16 x 16
    blocks = [np.zeros((n, 64), np.int64) for n in (6 * 4, 6, 6)]
    for b in blocks:
        b[:, 0] = rng.integers(-500, 500, len(b))
        b[:, 1:] = rng.integers(-60, 60, (len(b), 63)) * (rng.random((len(b), 63)) < 0.15)
    data, before, bits, mark = b"", [0, 0, 0], "", 0

    def packed(bits):
        raw = bytes(int((bits + "1" * 7)[i : i + 8], 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")

    def put(c, block):
        nonlocal bits
        size, extra = bits_of(int(block[0]) - before[c])
        before[c] = int(block[0])
        bits += codes(dc)[size] + extra
        run = 0
        last = max(np.flatnonzero(block[1:]), default=-1)
        for v in block[1 : last + 2]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + codes(ac)[0xF0], run - 16
            size, extra = bits_of(int(v))
            bits, run = bits + codes(ac)[run << 4 | size] + extra, 0
        if last < 62:
            bits += codes(ac)[0]

    for mcu in range(6):
        if mcu and mcu % 2 == 0:
            data, bits, before, mark = data + packed(bits) + bytes([0xFF, 0xD0 + mark]), "", [0, 0, 0], mark + 1
        row, column = divmod(mcu, 3)
        for y in (0, 1):
            for x in (0, 1):
                put(0, blocks[0][(2 * row + y) * 6 + 2 * column + x])
        put(1, blocks[1][mcu])
        put(2, blocks[2][mcu])
    data += packed(bits)
    stream = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes(range(2, 66))) + jpeg.segment(0xC0, bytes([8, 0, high, 0, wide, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    stream += jpeg.segment(0xC4, b"\0" + dc + b"\x10" + ac) + jpeg.segment(0xDD, b"\0\2") + jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    (image,) = jpeg.decode_images([stream])
    for got, want in zip(image.blocks, blocks, strict=True):
        assert (got == want).all()
    assert image.thumbnail().shape == (3, 5) and image.thumbnail()[0, 0] == np.clip(np.round(blocks[0][0, 0] * 2 / 8 + 128), 0, 255)
    with pytest.raises(ValueError):
        jpeg.decode_images([b"no picture"])
    with pytest.raises(ValueError):
        jpeg.decode_images([stream.replace(b"\xff\xc0", b"\xff\xc2")])


@pytest.mark.parametrize("rows", [odd_rows(), repeated_rows(), []])
def test_media_rows(spark, rows):
    media = jpeg.media_column(frame(spark, rows))
    streams = sorted((r.doc_id, bytes(r.media)) for r in media.collect() if r.doc_id is not None)
    got = jpeg.media_features(media).collect()
    assert len(got) == len(rows)
    for doc, text, *_ in odd_rows():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        for r in got:
            if r.doc_id == doc:
                stream = next(s for d, s in streams if d == doc)
                assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
