"""Each opN_ query and the pipeline as registered, over whole tables, against SQL, the public libraries and plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tessera.llm import queries  # noqa: E402

from ..test_queries import plain  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SMALL}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


@pytest.fixture(scope="module")
def small():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def run(spark, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, SMALL)


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES) and [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    df = run(spark, name)
    columns = sorted(df.columns)
    want = small.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr) and got


def test_op1(spark, documents):
    from tokenizers import Tokenizer

    df = run(spark, "op1_packing")
    assert {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}.items() <= dict(df.dtypes).items()
    tok, pieces, windows = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, {}
    for r in df.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {i for i, _ in documents}
    for i, t in documents:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in windows.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist() and sum(r.length for r in rs) <= 2048


def test_op3(spark, documents, small):
    df = run(spark, "op3_quality")
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = df.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op4(spark, documents):
    import tiktoken

    from tessera.llm import bpe

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op4_bpe").collect()}
    for i, t in documents:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op6(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op6_tokencount").collect()}
    for i, t in documents:
        n = len(lib.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_op8(spark, documents, small):
    """Both models in plain Python, over the whole table."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    good = {i for (i,) in small.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    split = [(i, words(t)) for i, t in documents]
    models = []
    for corpus in ([w for i, w in split if i in good], [w for _, w in split]):
        one, two, before = Counter(), Counter(), Counter()
        for w in corpus:
            one.update(w)
            pairs = list(zip([None, *w], w, strict=False))
            two.update(pairs)
            before.update(v for v, _ in pairs if v is None)
        models.append((one, two, before + one, sum(one.values())))
    size = len(models[1][0])
    got = {r.doc_id: r for r in run(spark, "op8_lmscore").collect()}
    assert len(got) == len(documents)
    for i, w in split:
        if not w:
            assert got[i].score is None and got[i].n_words == 0
            continue
        loss = []
        for one, two, _, total in models:
            begin = two.total() and sum(n for (v, _), n in two.items() if v is None)
            p = [(one[x] + 1) / (total + size) for x in w]
            loss.append(np.mean([-np.log2((two[v, x] + 50 * q) / ((begin if v is None else one[v]) + 50)) for v, x, q in zip([None, *w], w, p, strict=False)]))
        assert got[i].target_loss == pytest.approx(loss[0], abs=1e-9) and got[i].score == pytest.approx(loss[0] - loss[1], abs=1e-9)


def test_op9(spark, small):
    rows = small.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    got = {}
    for r in run(spark, "op9_ann").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for i, rs in got.items():
        s = x @ x[ids == i][0]
        s[ids == i] = -np.inf
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in rs)
        hits += len({r.vec_id for r in rs} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_op10(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op10_pii").collect()}
    assert sorted(got) == sorted(i for i, _ in documents)
    from tessera.llm import surrogates

    for i, t in documents:
        spans = surrogates.detect(t or "")
        assert got[i].n_replaced == len(spans)
        if not spans:
            assert got[i].text == t
        rest, last = [], 0
        for a, z, _ in spans:
            rest.append(re.escape(t[last:a]))
            last = z
        if spans:
            found = re.fullmatch("(.+?)".join([*rest, re.escape(t[last:])]), got[i].text, re.S)
            assert found and all(new != t[a:z] for new, (a, z, _) in zip(found.groups(), spans, strict=True))


def test_stages_with_nulls_and_clashes(spark):
    """Each stage but the last on null ids, null, empty and long texts, repeated rows, an empty table and columns that stages use themselves."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None), (2, ""), (2, ""), (None, "A b c. " * 30), (3, "Mail a.b@mail.example.org now, twice the line.\nMail a.b@mail.example.org now, twice the line."), (4, "word " * 30_000), (4, "word " * 30_000), (5, "One short line here\n" * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    wide = docs.selectExpr("*", "1 as row", "2 as score", "3 as first", "4 as n_dropped", "5 as marks")
    for (name, stage), want in zip(pipeline.STAGES[:-1], (None, 8, 7, 8), strict=True):
        for df in (docs, wide):
            out = stage(spark, df, SMALL)
            assert out.columns == docs.columns, name
            held = out.collect()
            assert want is None or len(held) == want, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    pieces = pipeline.STAGES[-1][1](spark, wide, SMALL).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None}


def test_pipeline_runs_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = pipeline.run(spark, SMALL).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
