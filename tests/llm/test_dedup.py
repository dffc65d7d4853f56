import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat.llm import exact_dedup, jaccard_join, suffix_dedup
from arborstat.llm.bwt import build, repeated_starts
from arborstat.llm.components import components
from arborstat.llm.exact_dedup import stream_dedup, without_copies
from arborstat.llm.shared import new_path

from .common import documents, frame, generated, near_components, odd_rows, repeated_rows, without_repeats


def plain(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def exact_groups(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), doc))
    return {d: (min(groups[plain(t)])[1], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for d, t in rows}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """Also with a digest under which most texts collide."""
    rows = [*odd_rows(), *((100 + k, *r[1:]) for k, r in enumerate(generated(60)))]
    digest = {"digest": lambda c: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(c.cast("binary")), F.lit(3))), 2, "0"))} if weak else {}
    got = stream_dedup(frame(spark, rows), **digest).collect()
    want = exact_groups([r[:2] for r in rows])
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_exact_dedup_goes_on_from_its_state(spark, monkeypatch):
    """Two arrivals into one folder are judged like one, the second against the first; also without broadcasts and with a weak digest."""
    weak = {"digest": lambda c: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(c.cast("binary")), F.lit(5))), 2, "0"))}
    rows = [*odd_rows(), *((100 + k, *r[1:]) for k, r in enumerate(generated(60)))]
    first, second = rows[::2], [*rows[1::2], *((200 + r[0], *r[1:]) for r in rows[::4])]
    for limit, how in ((exact_dedup.BROADCAST_HITS, {}), (0, {}), (0, weak)):
        monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", limit)
        folder = new_path(spark, "arrivals")
        early = stream_dedup(frame(spark, first), folder=folder, **how).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in early} == exact_groups([r[:2] for r in first])
        late = stream_dedup(frame(spark, second), folder=folder, **how).collect()
        want = exact_groups([r[:2] for r in [*first, *second]])
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in late} == {r[0]: want[r[0]] for r in second}
        assert all(r.kept == (r.doc_id == r.keep_id) for r in late)


def test_rows_with_one_id_and_text(spark):
    """Of rows that share an id and a text but for white space, the one with most code points stays; clashing names stay."""
    df = spark.createDataFrame([(1, "a b", 1), (1, "a  b", 2), (1, "a b ", 3), (1, "other", 4), (None, None, 5), (2, "", 6)], "doc_id long, text string, keep_id int")
    assert sorted(r.keep_id for r in without_copies(df.withColumn("digest", F.lit("x"))).collect()) in ([2, 4, 6], [3, 4, 6])


def test_rows_that_are_no_files_own(spark):
    """Rows that a plan makes of one file's row, or joins and unions give, are told apart; selections of files are read where they are."""
    path = new_path(spark, "own")
    frame(spark, odd_rows()).write.parquet(path)
    held = spark.read.parquet(path)
    assert exact_dedup.rows_of_files(held.where("doc_id > 1").select("doc_id", "text")) and not exact_dedup.rows_of_files(frame(spark, odd_rows()))
    for twice in (held.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))), held.unionByName(held), held.crossJoin(spark.range(2))):
        assert not exact_dedup.rows_of_files(twice)
        got = stream_dedup(twice).collect()
        want = exact_groups([r[:2] for r in odd_rows()])
        assert len(got) == 2 * len(odd_rows()) and {r.doc_id: (r.keep_id, r.group_size) for r in got} == {d: (k, 2 * n) for d, (k, n, _) in want.items()}
        assert sum(r.kept for r in got) == len({plain(r[1]) for r in odd_rows()})
    json = spark.read.schema(held.schema).json(held.toJSON().map(str))
    assert {r.doc_id: r.keep_id for r in stream_dedup(json).collect()} == {d: k for d, (k, _, _) in exact_groups([r[:2] for r in odd_rows()]).items()}


def test_exact_dedup_of_repeated_and_empty(spark):
    rows = repeated_rows()
    got = stream_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({plain(r[1]) for r in rows})
    assert stream_dedup(frame(spark, [])).count() == 0
    left = without_copies(frame(spark, rows))
    assert left.columns == frame(spark, []).columns and left.count() == len(kept)


def test_bwt_against_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 8))]
        order = sorted(([b + 1 for b in s[k:]] + [0], i, len(s) - k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        bwt, lcp = build(strings)
        assert bwt.tolist() == [strings[i][len(strings[i]) - n - 1] + 1 if n < len(strings[i]) else 0 for _, i, n in order]
        for k in range(1, len(order)):
            a, b = order[k - 1][0], order[k][0]
            same = 0
            while same < min(len(a), len(b)) - 1 and a[same] == b[same]:
                same += 1
            assert lcp[k] == same


def test_bwt_files_on_disk(tmp_path):
    strings = [b"banana", b"ananas", b"", b"nab"]
    assert [x.tolist() for x in build(strings, str(tmp_path))] == [x.tolist() for x in build(strings)]
    assert not list(tmp_path.iterdir())
    who, start, group = repeated_starts(strings, 3)
    assert sorted(zip(who.tolist(), start.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)] and len(set(group.tolist())) == 2


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 4])
def test_suffix_dedup(spark, monkeypatch, block):
    """Also with blocks so small that most anchors go the other way."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = [*odd_rows(), *((100 + k, *r[1:]) for k, r in enumerate(generated(60))), (500, "ab" * 700, *odd_rows()[0][2:]), (501, "z" * 400, *odd_rows()[0][2:])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), 100, keep=("lang",)).collect()
    want = without_repeats([r[:2] for r in rows], 100)
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.lang for r in got} == {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("size", [64, 255, 256, 300])
def test_suffix_dedup_of_other_sizes(spark, size):
    """Also of structured strings, on which hashes that are linear in the bytes collide."""
    odd = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    turned = odd.translate({97: "b", 98: "a"})
    shared = generated(1, 9)[0][1][:50] + "".join(f"{k} passage " for k in range(60))
    texts = [odd, turned, "x" + odd[:1024] + turned[1024:], turned[7:], *(t[:200] + shared + t[200:] for _, t, *_ in generated(12, 4)), "ab" * 700]
    rows = [(k, t, None, None, None, None, None, None) for k, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), size).collect()
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == without_repeats([r[:2] for r in rows], size)


def test_suffix_dedup_refuses(spark):
    df = frame(spark, odd_rows())
    for size, keep in ((4, ()), (6001, ()), (100, ("kept",))):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(df.withColumn("kept", F.lit(1)), size, keep=keep)


def test_suffix_dedup_of_repeated_and_empty(spark):
    rows = repeated_rows()
    got = suffix_dedup.remove_repeats(frame(spark, rows), 50).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    want = without_repeats([(n, rows[k][1]) for n, k in enumerate(order)], 50)
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((str(rows[k][0]), want[n][0]) for n, k in enumerate(order))
    assert suffix_dedup.remove_repeats(frame(spark, []), 50).count() == 0


def test_text_pieces_meet(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rows = generated(30)
    got = suffix_dedup.remove_repeats(frame(spark, rows), 100).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {d: w[0] for d, w in without_repeats([r[:2] for r in rows], 100).items()}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(spark, words, percent):
    rows = [*odd_rows(), *((100 + k, *r[1:]) for k, r in enumerate(generated(150)))]
    got = jaccard_join.near_components(frame(spark, rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components([r[:2] for r in rows], words, percent)


def test_jaccard_join_on_documents(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(df, 3, 90).collect()}
    assert got == near_components(rows, 3, 90)


def test_jaccard_join_with_long_runs(spark, monkeypatch):
    """Runs over the limit are dealt anew by other sketches."""
    monkeypatch.setattr(jaccard_join, "RUN", 3)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base, rows = [rng.choice(words) for _ in range(40)], []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(40)] = rng.choice(words)
        rows.append((k, " ".join(own), None, None, None, None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows), 3, 80).collect()}
    assert got == near_components([r[:2] for r in rows], 3, 80)


def test_blocks_that_are_left_out(spark):
    """Long sets leave out poor blocks; nothing differs from a run with the keys of every block."""
    rng, rows = random.Random(6), []
    for c in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(2500)]
        for k in range(6):
            own = list(base)
            for _ in range(rng.choice((5, 40, 70, 90))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            rows.append((6 * c + k, " ".join(own), None, None, None, None, None, None))
    one = jaccard_join.shingle_set(rows[0][1], 5)
    assert len(jaccard_join.sketch_keys(one, 80)) < len(jaccard_join.sketch_keys(one, 80, exact=True))
    got, whole = (sorted(map(tuple, jaccard_join.near_components(frame(spark, rows), 5, 80, exact=e).collect())) for e in (False, True))
    assert got == whole and {d: (n, c) for d, n, c in got} == near_components([r[:2] for r in rows], 5, 80)


def test_stars_with_salted_centres(spark, monkeypatch):
    """A centre with more pairs than one copy of its text takes; keys that most documents share."""
    monkeypatch.setattr(jaccard_join, "STAR", 2)
    monkeypatch.setattr(jaccard_join, "SEEN", 3)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for k in range(80):
        own = list(base)
        own[rng.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(own if k % 3 else base), None, None, None, None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(spark, rows).repartition(7), 3, 80).collect()}
    assert got == near_components([r[:2] for r in rows], 3, 80)


def test_jaccard_join_of_repeated_and_empty(spark):
    got = jaccard_join.near_components(frame(spark, repeated_rows()), 3, 90).collect()
    assert len(got) == len(repeated_rows()) and {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.component_id for r in got if r.doc_id in (0, 1, 9)} == {0}
    assert jaccard_join.near_components(frame(spark, []), 3, 90).count() == 0


def test_sketch_blocks_meet():
    """Of a pair over the threshold some block is the same in both: the pigeonhole bound holds at the edge."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 150, 700):
            for _ in range(20):
                pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 5).astype(np.uint64))
                same = int(rng.integers(1, n + 1))
                extra = max(0, 100 * same // percent - same)
                cut = int(rng.integers(0, extra + 1))
                a, b = pool[: same + cut], np.concatenate([pool[:same], pool[same + cut : same + extra]])
                a, b = np.sort(a), np.sort(b)
                assert jaccard_join.linked(a, b, percent)
                assert np.intersect1d(jaccard_join.sketch_keys(a, percent), jaccard_join.sketch_keys(b, percent)).size


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(60, 61), (61, 60), (5, 5)]
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 10 for k in range(11, 41)}, **{k: 100 for k in range(101, 130)}, 61: 60}
