"""Encoding, counting, packing, line deduplication and the shared word hashes, against plain definitions and the public libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe, common, linededup, packing, transducer  # noqa: E402

ODD = [" ", "\n", "\t", "  ", "a", "b", "'s", "é", "1", "２", "!", "　", "\x1c", "\x85", "字", "ab", "the", "'", "\r", "<|endoftext|>", "▁", "😀", "<s>", "    "]
texts = st.lists(st.sampled_from(ODD), max_size=40).map("".join) | st.text(max_size=40)
RANKS, JSON, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

#: Nulls, empty, blank, long, repeated and tied rows.
EDGES = [(0, None), (1, ""), (2, " \n "), (3, "x" * 300_000), (4, "ab " * 40_000), (5, "Same line here"), (6, "same LINE here  "), (5, "Same line here"), (None, "no id at all"), (7, "short\nshort")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_bpe_equals_library(oracle, text):
    text = text.encode("utf-8", "replace").decode()
    ids = bpe.rank_encoder(RANKS, P.PATTERN).encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text)
    assert bpe.rank_encoder(RANKS, P.PATTERN).bpe.decode(ids) == text.encode()


def test_bpe_long_words(oracle):
    rng = random.Random(2)
    long = ["a" * 5000, "ab" * 3000, "x" * 129, "".join(rng.choice("abcdefgh") for _ in range(3000)), "!" * 700]
    for t, ids in zip(long, bpe.rank_encoder(RANKS, P.PATTERN).encode(long), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(t)


def test_pair_table_holds_all():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    keys = np.unique(keys)
    t = bpe.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (t.get(keys >> 32, keys & 0xFFFFFFFF) == np.arange(len(keys))).all()
    assert (t.get(np.array([1 << 20]), np.array([7])) == bpe.NONE).all()


def test_encode_digest(spark, docs, oracle):
    rows = bpe.encode_digest(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(EDGES)
    for (i, t), r in zip(EDGES, rows, strict=True):
        ids = oracle.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    clash = docs.withColumnsRenamed({"doc_id": "ids"}).selectExpr("ids as doc_id", "text", "1 as decoded", "2 as n_tokens")
    assert bpe.encode_decode(clash, RANKS, P.PATTERN).columns == ["doc_id", "ids", "decoded"]
    assert bpe.encode_decode(docs.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_counts_equal_library(text):
    import sentencepiece

    text = text.encode("utf-8", "replace").decode()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert transducer.transducer(MODEL).count([text]).tolist() == [len(library.encode(text))]


def test_counts_of_long_and_blank_texts(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    long = ["a" * 3000, "the" * 2000, "".join(rng.choice("abcdethe") for _ in range(9000)), "字漢" * 1500, *(" " * m + "the" * (m % 3) for m in range(70))]
    assert transducer.transducer(MODEL).count(long).tolist() == [len(x) for x in library.encode(long)]
    for (i, t), r in zip(EDGES, transducer.count_tokens(docs, MODEL).collect(), strict=True):
        n = len(library.encode(t or ""))
        assert tuple(r) == (i, len((t or "").encode()), n, n > 4096)
    assert transducer.count_tokens(docs.limit(0), MODEL).count() == 0


def test_map_composition_reruns_wrong_guesses(monkeypatch):
    t = transducer.transducer(MODEL)
    text = "".join(random.Random(4).choice("abcdethe") for _ in range(5000))
    whole = t.count([text]).tolist()
    monkeypatch.setattr(transducer, "LEAD", 0)  # every guess is the start state
    monkeypatch.setattr(transducer, "CHUNK", 64)
    assert t.count([text, "", text]).tolist() == [whole[0], 0, whole[0]]


@settings(max_examples=200, deadline=None)
@given(text=texts)
def test_file_ids_equal_library(text):
    text = text.encode("utf-8", "replace").decode()
    e = packing.file_encoder(JSON, P.PATTERN)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 7, 30))])
        fee, window = rng.integers(0, 5, 31).astype(float), 16
        n = len(cuts)
        cost = lambda i, j: (0 if (size := int(cuts[j] - cuts[i])) & (size - 1) == 0 else window - size) + fee[j] + 3.0  # noqa: B023, E731
        best = [0.0] + [1e9] * (n - 1)
        for j in range(1, n):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if cuts[j] - cuts[i] <= window)
        path = [0, *packing.best_cuts(cuts, fee, window, 3.0)]
        assert path[-1] == n - 1 and sum(cost(i, j) for i, j in zip(path, path[1:], strict=False)) == pytest.approx(best[-1])


def test_pack(spark, docs):
    e = packing.file_encoder(JSON, P.PATTERN)
    rows = packing.pack(docs.where("doc_id is null or doc_id <> 5"), JSON, P.PATTERN, digest=True).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for i, t in EDGES:
        if i == 5:
            continue
        ids = np.append(np.frombuffer(e.encode([t or ""])[0], "<u4"), 1).astype("<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and sum(p.length for p in pieces) == len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and sum(p.length for p in pieces) <= 2048
    assert packing.pack(docs.limit(0), JSON, P.PATTERN).count() == 0
    assert "ids" in packing.pack(docs.limit(1).selectExpr("*", "1 as start", "2 as IDS"), JSON, P.PATTERN).columns


def test_packing_wastes_little(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "word.", "thing", "new\n"]) for _ in range(rng.randrange(20, 900)))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), JSON, P.PATTERN).groupBy("sequence_id").sum("length").collect()
    sizes = np.array([r[1] for r in got])
    padding = np.where(sizes & (sizes - 1), 2048 - sizes, 0).sum()
    assert padding < 0.02 * sizes.sum()


def plain_dedup(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_dedup_lines(spark, docs):
    rng = random.Random(6)
    pool = [f"  Line number {i} é" for i in range(30)] + ["tiny", "", "Ärger über alles", "ärger über alles"]
    rows = [*EDGES, *((i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(10, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == plain_dedup(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "1 as owner", "2 as `key`", "3 as N_Lines", "'x' as n_dropped2")
    assert linededup.dedup_lines(odd).columns == ["doc_id", "text", "owner", "key", "n_dropped2", "n_lines", "n_dropped"]


def test_runs_compact_and_reopen(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + i, bytes([i + b] * 16)) for i in range(3)], "doc_id long, key binary"))
    assert sum(map(len, runs.levels)) < 5
    owners = {bytes(r.key)[0]: r.owner for r in linededup.LineRuns.open(spark, runs.folder, 2).read().collect()}
    assert owners == {0: 0, 1: 1, 2: 2, 3: 12, 4: 22, 5: 32, 6: 42}


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=5))
def test_word_hashes(ts):
    ts = [t.encode("utf-8", "replace").decode() for t in ts]
    h, n = common.word_hashes(ts)
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in ts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
