"""All registered training-data queries and the pipeline on the small tables, against SQL, brute force and the library."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_text_operators import BYTE, LOWER, counts, groups, repeats, words

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.tokens import load_tokenizer
from tessera.llm.work import settle, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def run(spark):
    names = {int(n[2:].split("_")[0]): n for n in QUERIES}
    assert sorted(names) == list(range(1, 11))
    return lambda n: QUERIES[names[n]](spark, SF).collect()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(found.fetchall())


def test_tokens_and_packing(run, texts):
    plain, tok = load_tokenizer(BYTE, True), load_tokenizer(BYTE)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in run(1)) == Counter((d, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in texts.items())
    check_pieces(run(4), {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()})


def check_pieces(pieces, ids):
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert set(own) == set(ids)
    for d, found in own.items():
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) // 1024 + 2


def test_encoding(run, texts):
    tok = load_tokenizer(LOWER)
    want = set()
    for d, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r)[:4] for r in run(5)} == want


def test_shards(run, texts):
    load, places = Counter(), defaultdict(list)
    rows = run(6)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(load) <= set(range(24))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_quality(run, texts):
    rows = run(7)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == Counter((d, *counts(t)) for d, t in texts.items())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)


def test_neighbours(spark, run):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table(spark, SF, "embeddings").collect() if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(list)
    for r in run(8):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        score = (x @ x[at]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[at]))
        score[at] = -9
        best = np.lexsort((ids, -score))[:5]
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(best) + 1)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({int(ids[b]) for b in best} & {f[1] for f in found})
    assert hits >= 0.95 * 5 * len(got)


def test_languages(spark, run):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    rows = run(9)
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_archives(spark, run):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, SF, "pages").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    want = {(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == p else "revisit", None if first[h] == p else first[h]) for p, h in pages.items()}
    assert {tuple(r) for r in run(10)} == want


def test_pipeline(spark):
    """Every stage against a brute-force version of its own input; run() against the stages."""
    docs, tok = table(spark, SF, "documents"), load_tokenizer(BYTE)
    stages = dict(corpus_pipeline.STAGES)
    known = settle(stages["language_id"](spark, docs, SF), "a")
    good = settle(stages["quality_rules"](spark, known, SF), "b").collect()
    near = settle(stages["near_dedup"](spark, spark.createDataFrame(good, docs.schema), SF), "c").collect()
    assert docs.count() * 0.9 <= known.count() and known.columns == docs.columns
    assert all(counts(r["text"])[0] >= 50 for r in good)
    rows = [(r["doc_id"], r["text"]) for r in good]
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, _, c in groups(rows, 5, 80, 100) if d == c)
    cut = settle(stages["substring_dedup"](spark, spark.createDataFrame(near, docs.schema), SF), "d").collect()
    want = {r["doc_id"]: k for r, k in zip(near, repeats([r["text"] for r in near], 35), strict=True)}
    assert {r["doc_id"]: words(r["text"]) for r in cut} == want
    pieces = corpus_pipeline.run(spark, SF).collect()
    check_pieces(pieces, {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [0] for r in cut})
