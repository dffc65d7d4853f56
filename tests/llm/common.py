"""Rows with every odd case, and the brute-force versions that operators are held against."""

import random
import re

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size long, score double"
LONG = "lorem ipsum dolor sit amet " * 4000


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog and then runs away from the big bad wolf again and again " * 3
    return [
        (0, base, "en", "a", 1, 7, 7, 0.5), (1, base.replace(" ", "  "), "en", "a", 1, 7, 7, 0.5), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 7, 7, 0.5), (4, " \t\n", "en", "a", 0, 7, 7, 0.5),
        (5, LONG, "en", "b", 9, 7, 7, 0.5), (6, LONG + "x", "en", "b", 9, 7, 7, 0.5), (7, "a", "en", "b", 9, 7, 7, 0.5), (8, "Ünï çødé 漢字 😀 Σςσ <|endoftext|> '" + base, "de", "b", 9, 7, 7, 0.5),
        (9, base, "en", "a", 1, 7, 7, 0.5), (10, base + " one more word here", "en", "a", 1, 7, 7, 0.5), (11, "two words", "en", "a", 1, 7, 7, 0.5), (12, "two  words", "en", "a", 1, 7, 7, 0.5),
    ]


def repeated_rows():
    return [*odd_rows(), odd_rows()[0], (None, "no id at all", "en", "a", 1, 7, 7, 0.5), (None, None, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def documents(sf="sf0.001"):
    return duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet' order by doc_id").fetchall()


def generated(n=120, seed=3):
    """Documents with near copies, shared passages and chance overlaps."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = []
    passage = " ".join(rng.choice(words) for _ in range(80))
    for k in range(n):
        if k and k % 3 == 0:
            held = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(held) // 12))):
                held[rng.randrange(len(held))] = rng.choice(words)
            texts.append(" ".join(held))
        else:
            own = " ".join(rng.choice(words) for _ in range(rng.randint(1, 250)))
            texts.append(own[: len(own) // 2] + passage + own[len(own) // 2 :] if k % 7 == 0 else own)
    return [(k, t, "en", "a", len(t), 0, 0, 0.0) for k, t in enumerate(texts)]


def shingles(text, k):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(found)} if 0 < len(found) < k else {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def near_components(rows, k, percent):
    sets, label = {d: shingles(t, k) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(rows, size):
    seen, out = set(), {}
    for d, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            part = raw[i : i + size]
            if part in seen:
                gone[i : i + size] = [True] * size
            seen.add(part)
        out[d] = (bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))
    return out
