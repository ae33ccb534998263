"""Vector codes, collocations and licence notices against plain Python and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canvass.llm import collocations, licenses, vector_codes
from canvass.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


def same_rows(got, want, names):
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(tuple(r[c] for c in names) for r in got) == text(want)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_phrase_collocations"])
def test_query_matches_its_sql(spark, name, monkeypatch):
    db, sf = duckdb.connect(), SF if name.startswith("op11") else "/root/testdata/sf0.01"
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(llm_queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows
    got = llm_queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    same_rows(got.collect(), rows, names)


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(id, code, error) of each usable row, and the codebook."""
    kept = [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v in kept) // parts)) * parts
    limit = vector_codes.LARGEST
    ints = [(i, [max(-limit, min(limit, math.floor(x * 256))) for x in v] + [0] * (width - len(v)), v) for i, v in kept]
    w = width // parts
    first = sorted((r for r in ints if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    book = [[list(r[1][p * w : p * w + w]) for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((gap(v[p * w : p * w + w], c), e) for e, c in enumerate(book[p])) for p in range(parts)] for _, v, _ in ints]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [v[p * w : p * w + w] for (_, v, _), a in zip(ints, found, strict=True) if a[p][1] == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for (i, _, _), a in zip(ints, assign(), strict=True)], book


def vectors(seed, n, width, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(7)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    rows = vectors(1, 150, 8)
    rows += [(500, None), (501, [0.1, None] + [0.0] * 6), (502, [math.inf] * 8), (503, [math.nan] * 8), (504, []), (505, [0.5]), (None, [0.1] * 8)]
    rows += [(3, [0.2] * 8), (3, [0.2] * 8), (506, [1e30] * 8), (507, [-1e30] * 8), (508, [-1e38] * 3)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, code long, `a.b` string").repartition(3)
    for entries, rounds in ((5, 2), (64, 3), (1, 1)):
        coded, book, looked = vector_codes.vector_codes(df, "embedding", "vec_id", 4, entries, rounds)
        floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        want, want_book = plain_codes(floats, 4, entries, rounds)
        assert coded.columns == ["vec_id", "a.b", "code", "error"]
        same_rows(coded.collect(), want, ["vec_id", "code", "error"])
        assert book.tolist() == want_book
        assert len(looked) == rounds + 1 and looked[0] == 4 * len(want)
        assert vector_codes.codebook_digest(book) == hashlib.sha256(",".join(str(x) for p in want_book for e in p for x in e).encode()).hexdigest()


def test_heaps_leave_most_parts_of_settled_clusters_alone(spark):
    rows = vectors(2, 600, 8, 0.001)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    coded, _, looked = vector_codes.vector_codes(df, "embedding", "vec_id", 2, 7, 6)
    want, _ = plain_codes(rows, 2, 7, 6)
    same_rows(coded.collect(), want, ["vec_id", "code", "error"])
    assert looked[-1] < looked[0] / 2


def test_heap_pops_what_the_drift_reaches():
    heaps = vector_codes.Heaps(1, 2)
    heaps.fill(0, np.array([0, 1, 0]), vector_codes.Heaps.key(np.array([1.0, 2.0, 5.0]), np.zeros(1)), np.arange(3))
    assert heaps.pop(0, np.array([0.5, 1.0])).tolist() == []
    assert heaps.pop(0, np.array([1.0, 1.9])).tolist() == [0]
    again = vector_codes.Heaps.unpacked(*heaps.packed(), 1)
    assert again.heaps == heaps.heaps
    assert again.pop(0, np.array([5.0, 2.0])).tolist() == [1, 2]


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for some in (df, df.limit(0)):
        coded, book, looked = vector_codes.vector_codes(some, "embedding", "vec_id")
        assert coded.collect() == [] and looked == [] and book.size == 0
        assert coded.columns == ["vec_id", "code", "error"]


def test_label_sums_take_nulls_together(spark):
    df = spark.createDataFrame([(i, None if i % 3 else i % 2, i) for i in range(60)], "vec_id long, label int, error long")
    got = {(r["vec_id"]): r["label_error"] for r in vector_codes.label_sums(df, "label", "error", "label_error", ["vec_id"]).collect()}
    label = lambda i: None if i % 3 else i % 2
    assert got == {i: sum(j for j in range(60) if label(j) == label(i)) for i in range(60)}


# --- collocations


def plain_collocations(docs, least, longest, covered, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (cut[0], a, f[lang, p[: cut[1]]], f[lang, p[cut[1] :]])
    gone = {
        (lang, p[i : i + m])
        for (lang, p), (_, longer, _, _) in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
        if 100 * longer >= covered * found[lang, p[i : i + m]][1]
    }
    out = []
    for lang in n:
        rows = sorted((-s, -a, " ".join(p).encode(), le, r) for (la, p), (s, a, le, r) in found.items() if la == lang and (la, p) not in gone)
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(rows[:top])]
    return out


ROW = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("width", [2048, 1 << 14, None])
def test_collocations_are_those_of_plain_counts(spark, width, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 3000)
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(12)] + ["ñu", "É", " x", "a\x00b"]
    docs = []
    for i in range(120):
        words = [rng.choice(vocab[: rng.choice([4, 16])]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for w in words) + ("new york city hall" if rng.random() < 0.4 else "")
        docs.append((i, rng.choice(["en", "de fr", None, "und"]), text))
    docs += [(900, "en", None), (901, None, ""), (902, "xx", None), (903, "de_fr", "W1 W2 W1 W2"), (904, "en", "zig zag " * 4000), (0, "en", docs[0][2])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, lang string, text string, phrase string").repartition(3)
    for least, top in ((10, 2000), (3, 5)):
        got = collocations.collocations(df, least=least, top=top, width=width)
        assert got.columns == ROW
        same_rows(got.collect(), plain_collocations([d[1:] for d in docs], least, 4, 80, top), ROW)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(1, "en", "a b"), (2, None, None)], "doc_id long, lang string, text string")
    assert collocations.collocations(df).collect() == []
    assert collocations.collocations(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations.ngram_counts(df, least=300)


def test_sketch_bits_never_miss_a_frequent_ngram(spark):
    df = spark.createDataFrame([("en", "a b c d " * 20)] * 3 + [("en", f"u{i} v{i}") for i in range(300)], "lang string, text string").repartition(4)
    texts = df.select("lang", F.col("text").cast("binary").alias("text"))
    bits = collocations.frequent_bits(texts, 1 << 12, 30, 4)
    words = collocations.Words(pa.array([b"a b c d a b c d u1 v1"], type=pa.binary()), ["en"])
    found = {n: {words.phrase(i, n) for i in at.tolist()} for n, at, _ in collocations.candidates(words, bits, 1 << 12, 4)}
    assert {b"a", b"b", b"c", b"d"} <= found[1] and {b"a b", b"d a"} <= found[2] and {b"a b c d", b"b c d a"} <= found[4]
    assert not any(b"u1" in p for p in found[2])


def test_slices_are_unpacked_as_they_were():
    rng = np.random.default_rng(8)
    at = np.unique(rng.integers(0, 1 << 22, 5000)).astype(np.uint32)
    counts = rng.integers(1, 256, len(at))
    data = collocations.packed(at, counts)
    got = collocations.unpacked(pa.py_buffer(data), len(at))
    assert got[0].tolist() == at.tolist() and got[1].tolist() == counts.tolist() and len(data) < 3 * len(at)


# --- licence notices

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, own = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        own |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own))


def notice_texts():
    filler = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor".split()
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    out = [(None, None), ("", None), ("cc-by CC BY, by cc\nby", None), ("All Rights\nReserved. all rights reserved", None), ("Général public license é", None), ("general public license", None)]
    for label, notice, _ in licenses.NOTICES:
        out.append((f"{fill(40)}\n# {notice}.\n{fill(30)}", label))
    out += [(fill(200), None), ("license " * 3000, None), (fill(20_000) + " Released under the MIT License. " + fill(20_000), "mit")]
    out += [("the mit is under a license that was released", None), ("Licensed under the Apache foundation's newest version 2 of nothing", None)]
    return out


def test_notices_are_found_and_base_columns_are_plain(spark):
    texts = notice_texts()
    df = spark.createDataFrame([(i, t, "old", 5.0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, labels string, `odd.name` double").repartition(3)
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert len(got) == len(texts)
    for i, (text, label) in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)
        labels = set(filter(None, r["labels"].split(",")))
        assert set(filter(None, r["base_labels"].split(","))) <= labels
        assert (label in labels) if label else not labels - set(r["base_labels"].split(",")), (text and text[:200], r)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
        words = TOKEN.findall((text or "").lower())
        for n in r["notices"]:
            assert 0 <= n["start"] < n["end"] <= len(words)


def test_notices_may_be_edited_but_not_lack_their_key_phrase(spark):
    mit = licenses.NOTICES[18][1]
    assert licenses.NOTICES[18][0] == "mit"
    words = mit.split()
    edited = " ".join(words[:10] + words[11:14] + ["kindly"] + words[14:])
    without = mit.replace("hereby", "gladly")
    rows = [(1, f"x y {edited} z"), (2, f"x y {without} z"), (3, " ".join(reversed(words))), *((i, "plain words of no interest") for i in range(10, 40))]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and 0.75 <= got[1]["score"] < 1 and got[1]["notices"][0]["start"] in range(0, 5)
    assert got[2]["labels"] == got[3]["labels"] == got[10]["labels"] == ""


def plain_notices(words, index):
    """Every template at every place, whatever votes it has."""
    best = Counter()
    for t, (template, weight) in enumerate(zip(index.templates, index.weights, strict=True)):
        for b in range(-licenses.SHIFT, len(words)):
            share = sum(w for j, w in enumerate(weight) if any(0 <= b + j + s < len(words) and words[b + j + s] == template[j] for s in range(-licenses.SHIFT, licenses.SHIFT + 1))) / weight.sum()
            first, end = max(b - licenses.SHIFT, 0), min(b + len(template) + licenses.SHIFT, len(words))
            if share >= licenses.SHARE and all(len(licenses.consecutive(words[first:end], p)) for p in index.phrases[t]):
                best[index.labels[t]] = max(best[index.labels[t]], share)
    return best


def test_index_finds_what_comparing_everything_finds(spark):
    texts = [t or "" for t, _ in notice_texts() if t is None or len(t) < 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, n = licenses.frequencies(df, "text")
    vocab = licenses.vocabulary()
    words = licenses.hashed(texts)
    assert n == len(texts) and counts.tolist() == [sum(h in set(w.tolist()) for w in words) for h in vocab.tolist()]
    index = licenses.build_index(counts, n)
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, w in enumerate(words):
        want = plain_notices(w, index)
        found = Counter()
        for x in got[i]["notices"]:
            found[x["label"]] = max(found[x["label"]], x["share"])
        assert set(found) == set(want)
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_notices_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(df).collect() == []
