"""Mixing, fingerprints, similarity join, WARC, tool calls, language model and pipeline on small tables."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from canvass.llm import components, fingerprints, language_model, mixing, similarity_join, storage, toolchat, warc
from canvass.llm import queries as llm_queries
from canvass.plans import storage as plans_storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="s0"):
    return (i, text, "en", source, None if text is None else len(text))


def sentence(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with near and exact copies, shared passages and odd rows."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(3, 120)) for _ in range(n)]
    passage = sentence(rng, 60)
    out = []
    for words in base:
        out.append(list(words))
        if rng.random() < 0.4:
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(99)
            out.append(copy)
        if rng.random() < 0.3:
            out.append(passage + sentence(rng, rng.randint(0, 25)))
    rows = [doc(i, " ".join(w), f"s{i % 3}") for i, w in enumerate(out)]
    return rows + [doc(9001, None), doc(9002, ""), doc(9003, " \n\t "), doc(9004, "ONE two"), doc(9005, "one TWO"), doc(9006, "a b c d e f g " * 3000), doc(0, rows[0][1], "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


# --- components and join


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(70)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: found.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        ids[find(i)].append(d)
    return [(d, len(s), min(ids[find(i)])) for i, (d, s) in enumerate(sets)]


def test_join_links_what_brute_force_links(spark):
    rng = random.Random(11)
    rows = corpus(7, 40)
    core = sentence(rng, 50)
    for k in range(30):  # around the threshold, and a chain of edits
        words = list(core)
        for _ in range(k % 9):
            words[rng.randrange(50)] = f"x{rng.randrange(5)}"
        rows.append(doc(500 + k, " ".join(words)))
    out = similarity_join.similar_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(plain_components(rows))


def test_sets_that_share_half_a_digest_are_told_apart(spark):
    rng = random.Random(12)
    rows = corpus(8, 15)
    rows += [doc(700 + k, " ".join(sentence(rng, 20))) for k in range(10)]
    out = similarity_join.similar_components(spark.createDataFrame(rows, DOCS), node_bits=3).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(plain_components(rows))


def test_intermediate_tables_need_a_shared_folder_and_can_be_cleared(spark, tmp_path, monkeypatch):
    stored = storage.stored(spark.range(3), "x")
    path = stored.inputFiles()[0]
    assert os.path.exists(path.removeprefix("file://"))
    storage.clear(spark)
    assert not os.path.exists(path.removeprefix("file://"))

    class Remote:
        conf = type("N", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("C", (), {"applicationId": "a", "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        storage.shared_folder(Remote(), "x")


def test_join_of_nothing_and_of_clashing_columns(spark, docs):
    assert similarity_join.similar_components(docs.limit(0)).collect() == []
    clash = docs.withColumn("node", F.lit("x")).withColumn("token", F.lit(1)).withColumn("n", F.lit(2))
    kept = similarity_join.distinct_documents(clash)
    assert kept.columns == clash.columns
    found = similarity_join.similar_components(docs).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in found})


def test_rows_without_id_stay(spark):
    rows = spark.createDataFrame([doc(None, "a b c d e f"), doc(None, "a b c d e f"), doc(3, "a b c d e f"), doc(4, "q")], DOCS)
    assert sorted(str(r["doc_id"]) for r in similarity_join.distinct_documents(rows).collect()) == ["3", "4", "None", "None"]


def test_of_rows_repeated_with_one_id_the_smallest_stays(spark):
    rows = [doc(5, "b c d"), doc(5, "a c d"), doc(5, "a c d"), doc(6, "a c d"), doc(7, "q"), doc(7, "q"), doc(8, "z"), doc(None, "z")]
    kept = similarity_join.distinct_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", "a c d"), ("7", "q"), ("8", "z"), ("None", "z")]


def test_texts_of_unique_ids_are_shuffled_once_for_the_verdict(spark, tmp_path):
    spark.createDataFrame([doc(k, f"a b c d e {k // 2}") for k in range(20)], DOCS).write.parquet(f"{tmp_path}/d")
    kept = similarity_join.distinct_documents(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 20, 2))
    assert kept.inputFiles()
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"ReadSchema: \S*text:", plan)) == 1


def test_join_leaves_only_the_tables_that_its_result_reads(spark):
    made = plans_storage._MADE.setdefault(spark.sparkContext.applicationId, [])
    n = len(made)
    out = similarity_join.similar_components(spark.createDataFrame(corpus(7, 20), DOCS))
    there = {os.path.basename(f).removeprefix("canvass-").rpartition("-")[0] for f in made[n:] if os.path.exists(f.removeprefix("file://"))}
    assert {"profile", "of-node"} <= there and there.isdisjoint({"left", "sets", "sets-left", "ranked", "postings"})
    assert sorted(map(tuple, out.collect())) == sorted(plain_components(corpus(7, 20)))


def test_shuffle_files_of_a_stored_table_go_with_its_write(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}
    before = shuffled()
    key = plans_storage.SHUFFLE_CLEANUP
    was = spark.conf.get(key, None)
    table = storage.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x")
    for _ in range(50):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 7 and spark.conf.get(key, None) == was


# --- fingerprints


def test_edited_texts_and_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rows = [(r[0], r[1] or "") for r in corpus()][:-1]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    terms = fingerprints.lexicon(table, 0.0, 0.5)
    full = fingerprints.with_next(fingerprints.with_fingerprint(table, "text", "fp", terms), ["text", "fp"])
    full = full.withColumn("near", fingerprints.likeness(F.col("fp"), F.col("next_fp"))).collect()
    order = sorted(rows, key=lambda r: -r[0])
    following = {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}
    assert len(full) == len(rows) and all(r["next_text"] == following[r["doc_id"]] for r in full)
    by_text = collections.defaultdict(set)
    for r in full:
        by_text[r["text"]].add(r["fp"])
        assert 0 <= r["near"] <= 1 and (r["near"] == 1.0 or r["fp"] != r["next_fp"])
    assert all(len(v) == 1 for v in by_text.values())
    n = sum(g * k for _, g, k in fingerprints.LEVELS)
    assert by_text[""] == {fingerprints.UNFILLED * n}


def hashed(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def plain_terms(text: str) -> list[int]:
    return sorted({signed(hashed(t.encode())) for t in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower(), flags=re.A) if t})


def plain_fingerprint(terms: list[int]) -> str:
    out = ""
    for level, (one_in, groups, per_group) in enumerate(fingerprints.LEVELS):
        for k in range(groups * per_group):
            chosen = [t for t in terms if signed(hashed(level.to_bytes(4, "little"), hashed(t.to_bytes(8, "little", signed=True)))) % one_in == k]
            h = 42
            for t in chosen:
                h = hashed(t.to_bytes(8, "little", signed=True), h)
            out += f"{h % 65536:04x}" if chosen else fingerprints.UNFILLED
    return out


def test_fingerprints_are_those_of_the_exact_band(spark):
    rng = random.Random(31)
    rows = [(i, " ".join(f"{rng.choice('abcdefghij')}{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "Plain, plain; text!\n(again)")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    df = collections.Counter(t for _, text in rows for t in plain_terms(text))
    band = {t for t, n in df.items() if 0.01 * len(rows) <= n <= 0.2 * len(rows)}
    terms = fingerprints.lexicon(table, 0.01, 0.2)
    assert terms == sorted(band) and 20 < len(band) < len(df) / 2
    got = {r["doc_id"]: r["fp"] for r in fingerprints.with_fingerprint(table, "text", "fp", terms).collect()}
    assert got == {d: plain_fingerprint([t for t in plain_terms(text) if t in band]) for d, text in rows}


def test_next_rows_of_extreme_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    low, high = -(1 << 63), (1 << 63) - 1
    ids = [low, low + 1, high, high - 1, 0, *range(5, 25), None, None, low]
    rows = [(d, f"t{i:02d}") for i, d in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tie = {r["text"]: r["h"] for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    want = {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    out = fingerprints.with_next(table, ["text"]).collect()
    assert len(out) == len(rows) and {r["text"]: r["next_text"] for r in out} == want


def test_fingerprint_query_on_files(spark, docs, tmp_path):
    docs.withColumn("fingerprint", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    out = fingerprints.op4_imatch_fingerprints(spark, str(tmp_path)).collect()
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: -r[0])
    assert len(out) == len(rows)
    for i, (d, text) in enumerate(rows[:-2]):  # the last two share an id
        k = len(text) // 3
        edited = text[: len(text) - k] + rows[i + 1][1][:k]
        r = next(x for x in out if x["doc_id"] == d)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op4_imatch_fingerprints(spark, f"{tmp_path}/none").collect() == []


def test_fingerprint_plans_do_not_hold_the_lexicon(spark, tmp_path):
    sizes = {}
    for n in (200, 4000):
        rows = [(i, " ".join(f"w{(i * 7 + k) % n}" for k in range(40))) for i in range(200)]
        rows += [(1000 + i, " ".join(f"v{i * 40 + k}" for k in range(n // 20))) for i in range(20)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        table = spark.read.parquet(f"{tmp_path}/{n}/documents.parquet")
        terms = fingerprints.lexicon(table)
        out = fingerprints.op4_imatch_fingerprints(spark, f"{tmp_path}/{n}")
        sizes[len(terms)] = len(out._jdf.queryExecution().toString())
        got = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
        assert got == {d: plain_fingerprint([t for t in plain_terms(text) if t in set(terms)]) for d, text in rows}
    few, many = sorted(sizes)
    assert many > few + 1500 and sizes[many] < sizes[few] + 2000


# --- mixing


def test_exponent_meets_its_target(spark):
    p = np.array([0.6, 0.25, 0.1, 0.05])
    shares = spark.createDataFrame([(float(x),) for x in p], "p double")
    for limit in (1.2, 1.5, 3.0):
        a = mixing.exponent(shares, mixing.Target(max_repetition=limit))
        rep = lambda a: (p**a / (p**a).sum() / p).max()
        assert rep(a) <= limit + 1e-9 and (a == 0 or rep(a - 1e-6) > limit)
    a = mixing.exponent(shares, mixing.Target(entropy_share=0.9))
    h = lambda a: -(lambda w: (w * np.log(w)).sum())(p**a / (p**a).sum()) / math.log(4)
    assert abs(h(a) - 0.9) < 1e-6


def test_exponent_at_the_ends(spark):
    shares = spark.createDataFrame([(0.9,), (0.1,)], "p double")
    assert mixing.exponent(shares, mixing.Target(max_repetition=50.0)) == 0.0
    assert mixing.exponent(shares, mixing.Target(max_repetition=0.5)) == 1.0
    assert mixing.exponent(shares, mixing.Target(entropy_share=0.0)) == 1.0
    assert mixing.exponent(shares, mixing.Target(entropy_share=2.0)) == 0.0
    assert mixing.exponent(shares.limit(0), mixing.Target()) == 1.0


def test_a_null_source_is_a_source(spark):
    rows = [doc(i, "one two three four five six seven eight") for i in range(30)]
    df = spark.createDataFrame(rows, DOCS).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.lit("x")))
    out = mixing.mix(storage.stored(mixing.units(df), "u"), mixing.Target(max_repetition=1.2)).collect()
    weights = {r["source"]: r["source_weight"] for r in out}
    assert set(weights) == {None, "x"} and abs(sum(weights.values()) - 1) < 1e-9 and weights[None] > 1 / 3
    assert sum(r["source"] is None for r in out) == math.floor(weights[None] * 240) // 8


def test_mix_takes_whole_epochs_and_keeps_the_budget(spark, docs, monkeypatch):
    units = storage.stored(mixing.units(docs), "u")
    out = mixing.mix(units, mixing.Target(max_repetition=1.3), block_tokens=200).collect()
    tokens = collections.Counter()
    for r in units.collect():
        tokens[r["source"]] += r["n_tokens"]
    for source in tokens:
        mine = [r for r in out if r["source"] == source]
        weight, total = mine[0]["source_weight"], sum(tokens.values())
        quota = math.floor(weight * total)
        taken = sum(r["n_tokens"] for r in mine)
        longest = max(r["n_tokens"] for r in units.collect() if r["source"] == source)
        assert quota - longest <= taken <= quota or tokens[source] == 0
        every = {(r["doc_id"], r["h"]) for r in units.collect() if r["source"] == source}
        for epoch in range(quota // max(tokens[source], 1)):
            assert {(r["doc_id"], r["h"]) for r in mine if r["epoch"] == epoch} == every
        at = sorted((r["mix_position"], r["n_tokens"]) for r in mine if r["n_tokens"])
        assert all(abs(b[0] - a[0] - a[1] / quota) < 1e-9 for a, b in zip(at, at[1:], strict=False))
    mixed = mixing.mixed_documents(docs.withColumn("epoch", F.lit(1)))
    assert mixed.columns == [*docs.columns, "epoch"]
    assert mixing.mix(storage.stored(mixing.units(docs.limit(0)), "u")).collect() == []
    blank = docs.where("doc_id > 9000 AND doc_id < 9004").withColumn("source", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in mixing.mixed_documents(blank).collect()) == [9001, 9002, 9003]


# --- WARC


def test_archives_round_trip(spark, tmp_path):
    big = "<html>" + "x" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://b", "tiny"), (4, "http://c", "tiny"), (5, None, None), (6, "http://d\r\nX: y", "é" * 80), (7, "http://e", big), (None, "http://f", big), (8, "http://g", "é" * 80)]
    rows += [(100 + i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")

    def archive(name):
        folder = f"file://{tmp_path}/{name}"
        manifest = warc.write_warc(pages, folder, shard_bytes=3000, roll_bytes=600)
        files = {p.name: p.read_bytes() for p in (tmp_path / name).iterdir()}
        return manifest, folder, files

    manifest, folder, files = archive("a")
    assert archive("b")[2] == files and len(files) > 5 and "_temporary" not in files
    listed = {r["name"]: r for r in manifest.collect()}
    assert {n: hashlib.sha256(b).hexdigest() for n, b in files.items()} == {n: r["sha256"] for n, r in listed.items()}
    out = {r["page_id"]: r for r in warc.read_warc(manifest, folder).collect()}
    first: dict[bytes, int] = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            first.setdefault(data, page)
        r = out[page]
        back = first[data] if page is not None and len(data) >= 100 and first[data] != page else None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", back) if back else ("response", None))
    assert out[6]["target_uri"] == "http://d%0D%0AX:%20y"
    name = next(iter(files))
    (tmp_path / "a" / name).write_bytes(files[name][:-9])
    with pytest.raises(Exception, match="(?i)ends within|error|incorrect"):
        warc.read_warc(manifest, folder).collect()
    empty = warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert empty.collect() == [] and warc.read_warc(empty, f"file://{tmp_path}/none").collect() == []


def test_warc_shards_are_even_whatever_the_ids_span(spark, tmp_path):
    rng = random.Random(21)
    body = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 250)))
    wide = [(rng.randint(-(1 << 63), (1 << 63) - 1), "u", body()) for _ in range(300)]
    outlier = [(i, "u", body()) for i in range(300)] + [(1 << 62, "u", body())]
    equal = [(7, "u", body()) for _ in range(200)] + [(None, "u", body()) for _ in range(100)]
    for k, rows in enumerate((wide, outlier, equal)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        names = []
        for parts in (2, 5):
            folder = f"file://{tmp_path}/{k}-{parts}"
            manifest = warc.write_warc(pages.repartition(parts), folder, shard_bytes=4000)
            files = manifest.collect()
            assert len(files) >= 10 and max(f["records"] for f in files) <= 40
            assert sum(f["records"] for f in files) == len(rows)
            names.append(sorted((f["name"], f["sha256"]) for f in files))
        assert names[0] == names[1]  # the same archives however the rows lie
        found = warc.read_warc(manifest, folder).collect()
        want = sorted((r[0] is None, r[0] or 0, hashlib.sha256(r[2].encode()).hexdigest()) for r in rows)
        assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_digest"]) for r in found) == want


def test_warc_cuts_come_from_a_bounded_part_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_SAMPLE", 200)
    sizes = spark.range(20_000).select(F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(10).cast("long").alias("n"))
    cuts = warc.shard_cuts(sizes, 20_000, 10)
    starts = [0, *(c[0] for c in cuts), 20_000]
    assert 8 <= len(cuts) <= 12 and max(b - a for a, b in zip(starts, starts[1:], strict=False)) < 4_000
    assert cuts == warc.shard_cuts(sizes.repartition(7), 20_000, 10)



# --- tool calls


def test_tool_calls_are_linked_ordered_and_checked(spark):
    call = lambda *cs: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c, strict=False)) for c in cs]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "plain"),
        (1, 1, "assistant", call(("a", "add", '{"y": 2, "x": 1}', None), ("b", "add", '{"x": "no"}', "a"))),
        (1, 2, "tool", result("a", "3")),
        (1, 3, "assistant", call(("c", "add", "[1]", "b"), ("d", "gone", "{}", "missing"), ("a", "add", "{}", None))),
        (1, 4, "tool", result("zz", "?")),
        (1, 5, "assistant", call(("p", "add", '{"x":1,"y":2,"w":3}', "q"), ("q", "add", '{"x":1,"y":2}', "p"))),
        (1, 6, "assistant", "not json"), (1, 7, None, None), (None, 1, "assistant", call(("a", "add", '{"x":1,"y":-1}', None))), (2, 0, "tool", "{}"),
    ]
    messages = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, name string")
    schemas = {"add": {"x": toolchat.Field("integer"), "y": toolchat.Field("integer", minimum=0)}}
    out = {(r["conv_id"], r["call_id"]): r for r in toolchat.link_calls(*toolchat.calls_in_messages(messages), schemas).collect()}
    state = {k: (r["status"], r["depth"], r["errors"]) for k, r in out.items()}
    assert state == {
        (1, "a"): ("linked", 0, []),
        (1, "b"): ("no_result", 1, ["invalid:x", "missing:y"]),
        (1, "c"): ("no_result", 2, ["not_an_object"]),
        (1, "d"): ("no_result", 0, ["unknown_tool"]),
        (1, "p"): ("cycle", None, ["unknown:w"]),
        (1, "q"): ("cycle", None, []),
        (1, "zz"): ("no_call", None, []),
        (None, "a"): ("no_result", 0, ["invalid:y"]),
    }
    assert out[(1, "a")]["n_calls"] == 2
    text = out[(1, "a")]["json"]
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(text)["arguments"] == {"x": 1, "y": 2} and json.loads(text)["result"] == {"content": "3", "turn": 2}
    assert toolchat.link_calls(*toolchat.calls_in_turns(messages.limit(0)), toolchat.TURN_SCHEMAS).collect() == []


def test_long_chains_take_few_rounds(spark):
    n = 300
    calls = spark.createDataFrame([(1, i, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, turn long, call_id string, parent_id string")
    assert {(r["call_id"], r["depth"]) for r in toolchat.chain_depths(calls).collect()} == {(f"c{i}", i) for i in range(n)}


# --- language model


def test_backoff_scores_match_plain_counts(spark, docs):
    rows = [(r[0], [w.lower() for w in WORD.findall(r[1] or "")]) for r in corpus()]
    single, double = collections.Counter(), collections.Counter()
    for _, w in rows:
        single.update(w)
        double.update(zip(w, w[1:], strict=False))
    n = sum(single.values())
    want = []
    for d, w in rows:
        total, backed = 0.0, 0
        for i, x in enumerate(w):
            if i and double[(w[i - 1], x)] >= 2:
                total += math.log(double[(w[i - 1], x)] / single[w[i - 1]])
            else:
                total += math.log(single[x] / n) + (math.log(0.4) if i else 0.0)
                backed += i > 0
        want.append((d, len(w), backed, round(total, 6)))
    got = language_model.backoff_scores(docs.withColumn("block", F.lit("clash")), block_bytes=3000).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_backoff"], round(r["log_score"], 6)) for r in got) == sorted(want)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert language_model.backoff_scores(docs.limit(0)).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_takes_contexts_of_every_length(spark, docs, order):
    rows = [(r[0], [w.lower() for w in WORD.findall(r[1] or "")]) for r in corpus()]
    count = collections.Counter(tuple(w[i : i + n]) for _, w in rows for n in range(1, order + 1) for i in range(len(w) - n + 1))
    n_all = sum(len(w) for _, w in rows)

    def score(context, word):
        if not context:
            return count[(word,)] / n_all
        if count[(*context, word)] >= 2:
            return count[(*context, word)] / count[context]
        return 0.4 * score(context[1:], word)

    want = []
    for d, w in rows:
        contexts = [tuple(w[max(0, i - order + 1) : i]) for i in range(len(w))]
        backed = sum(bool(c) and count[(*c, x)] < 2 for c, x in zip(contexts, w, strict=True))
        want.append((d, len(w), backed, round(sum(math.log(score(c, x)) for c, x in zip(contexts, w, strict=True)), 6)))
    for block_bytes in (3000, 1 << 20):
        got = language_model.backoff_scores(docs, block_bytes=block_bytes, order=order).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_backoff"], round(r["log_score"], 6)) for r in got) == sorted(want)
    assert language_model.backoff_scores(docs.limit(0), order=order).collect() == []


def test_backoff_query_of_order_three_matches_its_sql(spark):
    got = llm_queries.QUERIES["op9_stupid_backoff_order3"](spark, SF).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(llm_queries.ORACLE_SQL["op9_stupid_backoff_order3"]).df().sort_values(["doc_id"]).reset_index(drop=True)
    assert got["n_backoff"].tolist() == want["n_backoff"].tolist() and got["n_words"].tolist() == want["n_words"].tolist()
    assert np.allclose(got["log_score"], want["log_score"], atol=2e-4)


# --- pipeline


def test_pipeline_hands_texts_to_python_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    operators = {"near_duplicates": "distinct_documents", "secrets": "redact_secrets", "packing": "pack_documents"}
    before = spark.conf.get(key)
    try:
        for given, most in ((before, 1000), ("0", 1000), ("300", 300)):  # a smaller number than the pipeline's own stays
            for stage, operator in operators.items():
                spark.conf.set(key, given)
                monkeypatch.setattr(corpus_pipeline, operator, lambda docs: docs.mapInArrow(sizes, "n long"))
                seen = [r["n"] for r in dict(corpus_pipeline.STAGES)[stage](spark, rows, "").collect()]
                assert sum(seen) == 5000 and max(seen) == most
    finally:
        spark.conf.set(key, before)


def test_pipeline_applies_its_stages(spark, docs, tmp_path):
    rng = random.Random(9)
    rows = corpus(2, 80) + [doc(7000 + i, " ".join(sentence(rng, 40)) + " password=hunter2222") for i in range(20)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {"": table}
    for name, stage in corpus_pipeline.STAGES:
        table = storage.stored(stage(spark, table, str(tmp_path)), name)
        seen[name] = table
    assert all(seen[n].columns == seen[""].columns for n, _ in corpus_pipeline.STAGES[:-1])
    kept = {r["doc_id"] for r in seen["quality"].collect()}
    assert 9006 not in kept and {9001, 9002, 9003}.isdisjoint(kept) and len(kept) > 50
    found = similarity_join.similar_components(seen["quality"]).collect()
    assert sorted(r["doc_id"] for r in seen["near_duplicates"].collect()) == sorted({r["component_id"] for r in found})
    masked = seen["secrets"].collect()
    assert len(masked) == seen["near_duplicates"].count() and not any("hunter2222" in r["text"] for r in masked)
    assert all(r["n_chars"] == len(r["text"]) for r in masked)
    pieces = seen["packing"].collect()
    assert sum(r["piece"] == 0 for r in pieces) == seen["mixing"].count()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))
