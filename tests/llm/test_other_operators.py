import base64
import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, warc
from tessera.llm.components import components
from tessera.llm.tokens import vocabulary
from tessera.llm.work import settle

SF = "/root/testdata/sf0.001"


# 8


def test_graphs_find_near_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 16))  # one tight cluster
    x[300:330] = x[300]  # equal vectors
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1050, [0.0] * 16, ""), (1100, [float("nan")] * 16, ""), (1150, [float("inf")] + [0.0] * 15, ""), (1200, [1.0, 2.0], ""), (None, x[5].tolist(), ""), (1250, [None] * 16, ""), (1300, [], ""), (300, x[300].tolist(), "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    valid = settle(ann.valid_vectors(frame), "v")
    assert valid.count() == 902
    index = ann.build_index(valid, 5, least_rows=400)
    assert sorted((r["dim"], r["shard"]) for r in index.collect()) == [(2, 0), (16, 0), (16, 1), (16, 2)]
    got = {}
    for r in ann.search(index, valid.where("id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))  # 1200 has no candidate of its length
    twice = got.pop(300)  # an id on two equal rows: each names the other first
    assert sorted(f[:2] for f in twice) == sorted([(k + 1, i) for k, i in enumerate((300, 301, 302, 303, 304))] * 2)
    wide = x.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1)
    hits = 0
    for q, found in got.items():
        score = (wide @ wide[q]) / (norms * norms[q])
        score[q] = -9
        best = np.lexsort((np.arange(900), -np.round(score, 12)))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hits += len(set(best.tolist()) & {f[1] for f in found})
    assert hits >= 0.95 * 5 * len(got)


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    valid = ann.valid_vectors(frame)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(ann.build_index(valid, 5), valid.where("id % 50 = 0"), 5).collect()}
    assert got == {(0, 1): 51, (0, 2): 50, (50, 1): 51, (50, 2): 0}
    rows = [(1, [0.99, 0.01]), (1, [0.0, 5.0]), (50, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1e-200, 1e-200]), (4, [1e200, 0.0])]
    valid = ann.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(ann.build_index(valid, 5), valid.where("id % 50 = 0"), 5).collect()]
    assert sorted(got) == [(1, 4, 1.0), (2, 1, 0.999949), (3, 3, 0.707107), (4, 1, 0.0)]  # rows that share an id are candidates each
    none = ann.valid_vectors(frame.where("false"))
    assert ann.search(ann.build_index(none, 5), none, 5).count() == 0


# 10


def test_archives(spark, tmp_path):
    big = "long " * 100_000
    rows = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, "http://b/ü x", big), (4, None, None), (5, "u", ""), (6, "u", "été\r\n\r\nWARC/1.1\0"), (None, "u", "same"), (7, "u", "own"), (7, "u", "own"), (None, "v", "only null")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=200)
    got = warc.read_records(index).collect()
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"])
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for page, _, html in rows:
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = bool(ids) and page != min(ids)
        want.append({"page_id": page, "payload_bytes": len((html or "").encode()), "payload_digest": sha(html), "record_type": "revisit" if revisit else "response", "refers_to": min(ids) if revisit else None, "payload": b"" if revisit else (html or "").encode()})
    assert [{k: (bytes(r[k]) if k == "payload" else r[k]) for k in want[0]} for r in sorted(got, key=key)] == sorted(want, key=key)
    some = warc.read_records(index.where("page_id IN (2, 6)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 6]
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/least", least=5), payload=False).collect()}
    assert kinds[3] == "response" and kinds[5] == "response"
    assert warc.read_records(warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")).count() == 0


def test_ranges_are_coalesced():
    rows = [(0, 10), (10, 5), (40, 5), (1000, 5), (1005, 90)]
    assert list(warc.ranges(rows, gap=30, most=100)) == [(0, 3, 0, 45), (3, 5, 1000, 1095)]
    assert list(warc.ranges(rows, gap=0, most=12)) == [(0, 1, 0, 10), (1, 2, 10, 15), (2, 3, 40, 45), (3, 4, 1000, 1005), (4, 5, 1005, 1095)]


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), "response", None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\npayload", b"\r\npayl0ad"))


# components


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], None])
def test_components(spark, edges):
    if edges is None:
        rng = random.Random(2)
        edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "packing"]
    rng = random.Random(4)
    speech = {"en": ["the", "house", "over", "which", "with"], "fr": ["le", "maison", "être", "où", "avec"]}
    prose = lambda lang, n: " ".join(rng.choice(speech[lang]) + rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, prose("en" if i % 2 else "fr", 80), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 0), (101, rows[4][1] + " edit", "fr", "s0", 0), (102, "1234 5678", "en", "s1", 0), (103, None, "en", "s1", 0), (104, "spam $$$ win " * 40, "en", "s1", 0)]
    passage = prose("en", 60)
    rows += [(105, f"{prose('en', 60)}\n{passage}", "en", "s2", 0), (106, f"{passage}\n{prose('en', 60)}", "en", None, 0)]
    own = ["score", "Kept", "n_words", "lang_pred", "tessera_key", "__places", "key", "again", "id", "row", "part"]  # names that the stages use themselves
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(k).alias(c) for k, c in enumerate(own)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(104, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *own]
            assert docs.select(*own).distinct().collect() == [tuple(range(len(own)))]
        if name == "substring_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = set(range(40)) | {105, 106}
    assert kept["language_id"] == whole | {100, 101, 104}
    assert kept["quality_rules"] == whole | {100, 101}
    assert kept["near_dedup"] == kept["substring_dedup"] == kept["packing"] == whole
    assert passage not in texts[105] and len(texts[105].split()) == 60 and texts[7] == rows[7][1]
    assert corpus_pipeline.ORACLE_SQL is None and "corpus_pipeline" in sys.modules and vocabulary(corpus_pipeline.VOCABULARY)
