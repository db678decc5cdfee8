"""The pipeline's stages on a small corpus, and the queries against their SQL."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import hashlib  # noqa: E402
import re  # noqa: E402

import numpy as np  # noqa: E402
from test_llm_operators import brute_lines, brute_near, prose, public_tokenizers, sha  # noqa: E402

from citeloom.llm import mixing, quality, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= {*before}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(columns)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.95 * len(good)
            bad = [d for d, q in labels.items() if q == 0]
            assert sum(d in kept for d in bad) <= 0.2 * len(bad)
            assert all(r["text"] == before[r["doc_id"]] for r in rows)
        if name == "line_dedup":
            assert len(rows) == len(before)
        if name == "near_dedup":
            stay = {d for d, _, _, kept in brute_near([(d, t or "", None) for d, t in before.items()], 5, 80) if kept}
            assert sorted(r["doc_id"] for r in rows) == sorted(stay)
        if name == "bpe":
            assert len(rows) == docs.count()
        docs = out


def test_near_stage_keeps_rows_without_id_and_equal_rows_once(spark):
    text = "some words that make a document long enough to have shingles of five words " * 3
    rows = [(1, text), (1, text), (2, text), (3, "another text altogether with its own words in it"), (None, text), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, docs, DATA).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == [1, 3, 4, None]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, score double, key string, part int, hashes binary"


def odd_tables(spark, path, rows):
    """documents with clashing extra columns, and labels with nulls, unknown ids and repeats."""
    made = [(d, t, "en", s, len(t or ""), "clash", 1, 2.0, "k", 3, b"x") for d, t, s in rows]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 0 if t and "***" in t else 1, 0) for d, t, _ in rows if d is not None] + [(None, 1, 0), (3, None, 0), (10**9, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def odd_rows():
    rows = [(i, prose(i, 40 + i), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, " ".join(w + "***" for w in prose(i, 60).split()), "s1") for i in range(40)]
    rows += [(200 + i, f"a line that many of them hold\n{prose(300 + i, 50)}\n  A line that MANY of them hold ", "s2") for i in range(12)]
    base = prose(77, 200)
    rows += [(300 + i, base.replace(base.split()[9], f"edit{i}", 1), "s0") for i in range(8)]
    rows += [(400, prose(78, 20_000), "s0"), (401, "z" * 100_000, None), (402, "", "s0"), (403, None, None), (404, " \n ", "s9")]
    rows += [(5, prose(500, 60), "s4"), (5, prose(500, 60), "s4"), (205, prose(501, 70), "s4")]  # ids that come again, with other texts and the same
    rows += [(None, prose(502, 30), "s1"), (None, prose(502, 30), "s1"), (None, prose(503, 30), None), (None, None, None)]
    return rows


def test_every_stage_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = odd_rows()
    path = odd_tables(spark, tmp_path, rows)
    outs, docs = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = docs.collect()
        assert name == "bpe" or docs.columns == list(corpus_pipeline.COLUMNS)
    as_rows = lambda name: sorted(((r["doc_id"], r["text"], r["source"]) for r in outs[name]), key=repr)
    ranking = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    want = [(d, t, s) for d, t, s in rows if ranking.scores(np.array([quality.features((t or "").encode())]))[0] >= 0.7]
    assert as_rows("quality_classifier") == sorted(want, key=repr)
    assert not any(t and "***" in t for _, t, _ in want) and len(want) > 70  # junk goes, prose stays

    plain = [(d, t or "", s) for d, t, s in want]
    lines = {(d, n, gone, sha) for d, n, gone, sha in brute_lines(plain)}
    got = as_rows("line_dedup")
    assert len(got) == len(plain) and {sha(t) for _, t, _ in got} == {x[3] for x in lines}
    assert sum("many of them hold" in t.lower() for _, t, _ in got) == 1

    known = {}
    for d, t, _ in got:
        if d is not None:
            known.setdefault(d, set()).add(t)
    single = [(d, next(iter(ts)), None) for d, ts in known.items() if len(ts) == 1]
    dropped = {d for d, _, _, kept in brute_near(single, 5, 80) if not kept}
    near = as_rows("near_dedup")
    assert {d for d, _, _ in near if d is not None} >= {d for d, _, _ in single} - dropped
    assert {d for d, _, _ in near if d is not None} <= {*known} - {d for d in dropped if d not in (5, 205)}
    assert sum(d is None for d, _, _ in near) == sum(d is None for d, _, _ in got)  # rows without an id stay
    assert {t for d, t, _ in near if d in (5, 205)} >= {prose(500, 60)}

    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    taken = {}
    for r in mixing.mix(spark.read.parquet(f"{tmp_path}/near_dedup")).collect():
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + r["taken"]
    mixed = {}
    for d, t, s in as_rows("source_mix"):
        mixed[d, s] = mixed.get((d, s), 0) + words(t)
    assert mixed == {k: n for k, n in taken.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in outs["bpe"]}
    encoded = [(d, library.encode(t, add_special_tokens=False).ids) for d, t, _ in as_rows("source_mix")]
    assert ids == {(d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for d, x in encoded} and len(outs["bpe"]) == len(encoded)
    assert corpus_pipeline.run(spark, path).count() == len(encoded)


def test_stages_on_an_empty_table(spark, tmp_path):
    path = odd_tables(spark, tmp_path, [(1, "x", "s")])
    none = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, path)
        assert out.collect() == [] and (name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = sorted((tuple(r[found.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
