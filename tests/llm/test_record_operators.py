"""Fill-in-middle, whitening and piece encoding, on labels and cubes of the project and on the given tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle_check import DATA
from pyspark.sql import functions as F

from tieline.llm import fill_middle, label_pieces, whiten
from tieline.llm.queries import LLM_QUERIES

FOLDER = f"{DATA}/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LABEL = """<?xml version="1.0"?>
<Product_Observational><File><file_name>ch2_ohr_{i}.img</file_name></File>
  <pixel_resolution unit="m/pixel">0.{i}</pixel_resolution>  <area>Südpol {i}</area>
</Product_Observational>"""
LONG = " ".join(f"line{i % 997}\tsample{i % 13} é漢😀" for i in range(40_000))
TEXTS = [None, "", " ", "x", "é", "😀", "a<P>b", "<S", "<M>", "漢字かな交じり文", "▁▁ a ▁", "\x00\x01<s></s><0x41>", "same", "same", " \n\t  \r\n", LONG, "z" * 70_000] + [LABEL.format(i=i) for i in range(40)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(f"label{i % 50}", t, 1, "form", [1], "n") for i, t in enumerate(TEXTS)] + [(None, "no path", 1, "form", [1], "n")]
    return spark.createDataFrame(rows, "path string, xml string, frames int, form string, ids array<int>, `output` string").repartition(3)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# ---- fill in middle

def example(key, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}", "spm": f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"}[form]
    cut = form != "plain"
    return n, form, p if cut else None, q - p if cut else None, sha(out), sha(text)


@pytest.mark.parametrize("units", [1, 5, 64])
def test_frames_are_seekable(units):
    rng, io = random.Random(units), fill_middle.Frames(units)
    for _ in range(200):
        text = "".join(rng.choice("ab<PS>Mé漢😀\n") for _ in range(rng.randint(0, 60)))
        frames = io.write([text[:9].encode(), b"", text[9:].encode()])
        assert b"".join(io.read(frames)).decode() == text and sum(f["n_units"] for f in frames) == len(text)
        a = rng.randint(0, len(text))
        b = rng.randint(a, len(text))
        assert b"".join(io.read(frames, a, b)).decode() == text[a:b]
        marks = (b"<P>", b"<S>", b"<M>")
        assert io.find(frames, marks) == {m: text.index(m.decode()) for m in marks if m.decode() in text}


def test_a_cut_opens_only_its_frames():
    io = fill_middle.Frames(10)
    frames = io.write([("0123456789" * 50).encode()])
    opened = []
    unpack = io.unpack
    io.unpack = lambda data: opened.append(1) or unpack(data)
    assert b"".join(io.read(frames, 255, 258)) == b"567" and len(opened) == 1


@pytest.mark.parametrize("units", [7, 4096])
def test_examples_of_labels(spark, labels, units):
    made = fill_middle.fill_in_middle(fill_middle.store_frames(labels, units=units), units=units)
    out = fill_middle.restore_labels(made, ["path", "n", "form", "prefix_units", "middle_units", "output_sha256"], frames=True)
    want = sorted(map(str, ((r.path, *example(r.path, r.xml)) for r in labels.collect())))
    got = out.collect()
    assert sorted(str(tuple(r)[:-1]) for r in got) == want
    io = fill_middle.Frames()
    assert all(hashlib.sha256(b"".join(io.read([f.asDict() for f in r.restored]))).hexdigest() == r.restored_sha256 for r in got)
    none = fill_middle.fill_in_middle(fill_middle.store_frames(labels.limit(0)))
    assert fill_middle.restore_labels(none).count() == 0


def test_fill_in_middle_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in LLM_QUERIES["op11_fill_in_middle"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert got == {d.doc_id: example(d.doc_id, d.text) for d in docs}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


# ---- whitening

@pytest.mark.parametrize("n", [1, 2, 3, 6, 64, 150])
@pytest.mark.parametrize("kind", ["spread", "equal", "pairs", "close", "zero", "low rank"])
def test_leading_components(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    d = {"spread": np.arange(n, 0, -1.0), "equal": np.ones(n), "pairs": np.repeat(np.arange(n, 0, -1.0), 2)[:n], "zero": np.zeros(n),
         "close": np.r_[3, 3 - 1e-9, 3 - 1e-14, 2.9, np.ones(n)][:n], "low rank": np.r_[9.0, 4.0, np.zeros(n)][:n]}[kind]
    a = q @ np.diag(d) @ q.T
    a = (a + a.T) / 2
    values, vectors = whiten.leading_components(a, 4)
    assert len(values) == min(4, n) and np.allclose(values, np.sort(d)[::-1][:4], atol=1e-11 * n)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * np.array(values)).max() < 1e-11 * max(1, np.abs(d).max())


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[3, 17]] = 0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in (-9.0, -1.0, 0.0, 0.3, 9.0):
        assert whiten.sturm_count(d.tolist(), e.tolist(), x) == (true < x).sum()


def brute_whitening(table):
    """key -> (n, deviation, whitened up to sign, explained) from NumPy's own eigenvectors."""
    x = np.floor(256 * np.array([v for _, v in table], float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    cov = (u - s / n).T @ (u - s / n) / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vector / np.sqrt(value), value / np.trace(cov)


def test_whitening_of_a_cube(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 9)) * np.array([5, 3, 2, 1.5, 1, .5, .4, .3, .2])
    table = [((i // 40, i % 40 // 8, i % 8), base[min(i, 100)].tolist()) for i in range(120)]  # 20 repeats of one spectrum
    odd = [((9, 0, 0), None), ((9, 0, 1), [1.0] * 8 + [None]), ((9, 0, 2), [float("nan")] + [0.0] * 8), ((9, 0, 3), [float("-inf")] * 9), ((9, 0, 4), [])]
    schema = "product_id int, line int, sample int, spectrum array<double>, n string, component string"
    cube = spark.createDataFrame([(*k, v, "x", "y") for k, v in table + odd], schema)
    model = whiten.fit_whitening(cube)
    out = whiten.whiten_spectra(cube, model).collect()
    n, deviation, white, share = brute_whitening(table)
    assert len(out) == 4 * len(table) and model.n == n == 101
    place = {k: i for i, (k, _) in enumerate(table)}
    got = np.zeros_like(white)
    for r in out:
        i = place[r.product_id, r.line, r.sample]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[i] and abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    for few, components in ((cube.where("product_id = 9"), 0), (cube.where("product_id = 0 AND line = 0 AND sample < 2"), 1), (cube.where("product_id = 2 AND line = 4"), 0), (cube.limit(0), 0)):
        fit = whiten.fit_whitening(few)
        assert len(fit.values) == components and whiten.whiten_spectra(few, fit).count() == components * few.where("product_id < 9").count()
    with pytest.raises(ValueError):
        whiten.fit_whitening(cube.select(F.slice("spectrum", 1, F.when(F.col("line") == 1, 3).otherwise(9)).alias("spectrum")))
    huge = spark.createDataFrame([(i, 0, 0, [1e9 * i, 1.0 * i * i]) for i in range(5)], "product_id int, line int, sample int, spectrum array<double>")
    assert {r.deviation for r in whiten.whiten_spectra(huge, whiten.fit_whitening(huge)).collect() if r.product_id == 0} == {None}


def test_whitening_query(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    n, deviation, white, share = brute_whitening(table)
    out = LLM_QUERIES["op12_whitening"](spark, FOLDER).toPandas().pivot(index="vec_id", columns="component", values="whitened").loc[[k for k, _ in table]].to_numpy()
    assert np.abs(out * np.sign((out * white).sum(0)) - white).max() < 1e-9


# ---- pieces

@pytest.fixture(scope="module")
def vocab():
    return label_pieces.Vocabulary(label_pieces.load_model(MODEL))


def ids_of(vocab, text):
    return np.frombuffer(vocab.encode(text), np.int32).tolist()


def test_every_piece_and_odd_text(vocab, library):
    rng = random.Random(3)
    for piece in vocab.text:
        assert ids_of(vocab, piece) == library.encode(piece)
    for text in [t for t in TEXTS if t] + [" " * k for k in range(80)] + ["th" * 3000 + "ing" * 1000, "▁" * 500]:
        assert ids_of(vocab, text) == library.encode(text)
    letters = list("▁ aeionrstlhdcm  \n0123,.()\"'éß漢字ไ😀\x00<s>/") + ["the", "ing", "   ", "        ", "tion"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert ids_of(vocab, text) == library.encode(text)
    for _ in range(4000):
        text = "".join(rng.choice(vocab.text) for _ in range(rng.randint(1, 6))).replace("▁", rng.choice(" ▁"))
        assert ids_of(vocab, text) == library.encode(text)


def test_merging_decides(vocab, library):
    """Neighbours that fit are exactly those that merging leaves as they are."""
    for word in ["registration", "hyperspectral", "illumination", "Chandrayaan"]:
        parts = vocab.merge("▁" + word)
        assert parts == library.encode(word, out_type=str)
        for a, b in zip(parts, parts[1:]):
            assert vocab.fit(vocab.place[a], vocab.place[b]) == vocab.place[b]


def test_small_memories(library, monkeypatch):
    monkeypatch.setattr(label_pieces, "SEEN_CHARS", 50)
    monkeypatch.setattr(label_pieces, "SEEN_PAIRS", 20)
    vocab = label_pieces.Vocabulary(label_pieces.load_model(MODEL))
    for i in range(30):
        assert ids_of(vocab, LABEL.format(i=i)) == library.encode(LABEL.format(i=i))


def test_labels_there_and_back(spark, labels, library):
    model = label_pieces.load_model(MODEL)
    coded = label_pieces.encode_labels(labels, model, ["path", "form"])
    rows = labels.collect()
    assert sorted(map(str, ((r.path, r.form, list(r.ids)) for r in coded.collect()))) == sorted(map(str, ((r.path, r.form, library.encode(r.xml or "")) for r in rows)))
    text = label_pieces.decode_labels(coded, model)
    assert sorted(map(str, map(tuple, text.collect()))) == sorted(map(str, ((r.path, library.decode(library.encode(r.xml or ""))) for r in rows)))
    gaps = spark.createDataFrame([("a", None), ("b", []), ("c", library.encode("ok go"))], "path string, ids array<int>")
    assert {r.path: r.xml for r in label_pieces.decode_labels(gaps, model).collect()} == {"a": None, "b": "", "c": "ok go"}
    assert label_pieces.encode_and_decode(labels.limit(0), model).count() == 0


def test_sentencepiece_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in LLM_QUERIES["op13_sentencepiece"](spark, FOLDER).collect()}
    want = {}
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode(d.text or "")
        want[d.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want


def test_only_bpe_models_are_taken(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        label_pieces.load_model(str(tmp_path / "m"))


# ---- archives

def test_chunks_carry_the_digest_on(spark):
    """Every chunk row has the digest of the payload up to its end; no task collects a page's chunks first."""
    from base64 import b32encode

    from tieline.llm import warc

    pages = {1: "é" * 1000 + "x" * 700, 2: None, 3: "short", 4: "short"}
    df = spark.createDataFrame([(k, "u", v) for k, v in pages.items()], "page_id bigint, url string, html string")
    rows = warc.chunk_rows(df, chunk_chars=256).collect()
    for r in rows:
        page = int(r.record_id.split(":")[2])
        body = (pages[page] or "")[:256 * r.chunk_no] if page != 4 else "short"
        assert r.digest_so_far == b32encode(hashlib.sha1(body.encode()).digest()).decode()
    assert sorted((int(r.record_id.split(":")[2]), r.chunk_no) for r in rows) == [(1, k) for k in range(1, 8)] + [(2, 1), (3, 1), (4, 1)]
