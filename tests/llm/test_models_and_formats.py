"""Tokenizers, packing, classifiers, archives, search and chat: against libraries, brute force and held-out rows."""

import base64
import hashlib
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import prose
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringStartsWith

from veilwright.llm import (
    chat,
    compression_quality,
    labelled,
    packing,
    sentencepieces,
    topk,
    toxicity,
    warc,
)
from veilwright.sources.scratch import written

tokenizers = pytest.importorskip("tokenizers")
spm = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

BPE, PIECES = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")


# --- SentencePiece -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Encoder(PIECES), spm.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library_on_random_texts(pieces):
    mine, library = pieces
    rng = random.Random(4)
    some = [t for t in mine.model.texts if t]
    texts = ["".join(rng.choice("ab tehin\n\té.,▁0日🙂") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    texts += ["", " ", "a" * 500, " " * 300, "\0a\0", "▁▁x", "def f(x):\n        return x", "<s> <unk> <0x0A>", "é" * 70]
    for text, ids in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert mine.model.decode(ids).decode() == library.decode(library.encode(text)), text


def test_piece_occurrences_against_scans(pieces):
    model = pieces[0].model
    data = b" the cat sat on the  mat. russkij \xd1\x80\xd1\x83\xd1\x81\xd1\x81\xd0\xba\xd0\xb8\xd0\xb9\0 international\0"
    at, which = model.occurrences(np.frombuffer(data, np.uint8))
    found = {(int(a), model.texts[model.pattern_piece[w]]) for a, w in zip(at, which, strict=True)}
    expected = {(k, t) for m in model.pattern_piece for t in [model.texts[m]]
                for b in [t.replace("▁", " ").encode()] for k in range(len(data)) if data.startswith(b, k)}
    assert found == expected


def test_piece_tables(make_docs, messy):
    rows = sentencepieces.decode(sentencepieces.encode(make_docs(messy), PIECES), PIECES).collect()
    back = sorted(((r["doc_id"], None if r["text"] is None else bytes(r["text"]).decode()) for r in rows), key=repr)
    assert back == sorted(messy, key=repr)
    again = sentencepieces.encode(make_docs(messy), PIECES, with_text=True).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert sentencepieces.encode(make_docs([]), PIECES).collect() == []


# --- packing -------------------------------------------------------------------------------


def test_pieces_of_odd_rows_equal_the_library(make_docs, messy):
    library = tokenizers.Tokenizer.from_file(BPE)
    expected = []
    for i, text in messy:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            expected.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    packed = packing.pack_documents(make_docs(messy), BPE).collect()
    assert sorted((tuple(r[:5]) for r in packed), key=repr) == sorted(expected, key=repr)
    check_sequences(packed, 2048)


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_an_empty_table(make_docs):
    assert packing.pack_documents(make_docs([]), BPE).collect() == []


def test_packing_in_several_groups(spark):
    rng = random.Random(8)
    rows = [(i, 0, 0, rng.randrange(1, 101), 0) for i in range(500)]
    df = written(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7), "p")
    packed = packing.pack(df, 100, 100).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(500))
    assert check_sequences(packed, 100) <= sum(r[3] for r in rows) / 100 * 1.03 + 5


def test_local_search_empties_bins():
    # Best fit leaves three bins here; an exchange of one for one empties the last.
    lengths = np.array([6, 5, 4, 3, 2])
    bins = [[0, 3], [1, 2], [4]]
    packing.improve(bins, lengths, 10)
    assert sum(map(bool, bins)) == 2 and all(lengths[b].sum() <= 10 for b in bins)
    lengths = np.array([5, 4, 4, 3, 2, 2])
    bins = [[0, 1], [2, 3], [4, 5]]
    packing.improve(bins, lengths, 10)
    assert sum(map(bool, bins)) == 2 and all(lengths[b].sum() <= 10 for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_search_never_breaks_a_bin(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 300)
    bins = packing.best_fit(lengths, 100)
    before, squares = len(bins), sum(int(lengths[b].sum()) ** 2 for b in bins)
    packing.improve(bins, lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(lengths[b].sum() <= 100 for b in bins) and sum(map(bool, bins)) <= before
    assert sum(int(lengths[b].sum()) ** 2 for b in bins) >= squares


# --- classifiers ---------------------------------------------------------------------------


def labelled_docs(make_docs, spark, bad):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        text, label = prose(i, rng.randrange(60, 160)), int(rng.random() < 0.3)
        rows.append((i, bad(text, rng) if label else text))
        marks.append((i, 1 - label, label))
    marks += [(900, None, None), (None, 1, 1), (901, 1, 0)]
    rows += [(950, None), (951, ""), (None, prose(1, 60)), (0, rows[0][1])]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    return make_docs(rows), labels, {i: (q, t) for i, q, t in marks}


def test_toxicity_learns_words(make_docs, spark):
    def bad(text, rng):
        words = text.split()
        words[rng.randrange(len(words)):0] = ["You", rng.choice(["Rotter!", "knave,", "SCOUNDREL"])]
        return " ".join(words)

    docs, labels, truth = labelled_docs(make_docs, spark, bad)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [(r["predicted"], truth[r["doc_id"]][1]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_learns_texture(make_docs, spark):
    docs, labels, truth = labelled_docs(make_docs, spark, lambda text, rng: " ".join(w + "***%%" for w in text.upper().split()))
    rows = compression_quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [(r["predicted"], truth[r["doc_id"]][0]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    model = compression_quality.fit(docs, labels)
    kept = compression_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"own"}
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, (q, _) in truth.items() if q == 1 and i is not None and i < 400}


def test_dictionaries_train_on_all_blocks(monkeypatch):
    import zstandard

    seen = []

    def train_dictionary(size, blocks, **options):
        seen.append(b"".join(blocks))
        return zstandard.ZstdCompressionDict(b"some dictionary")

    texts = [bytes([97 + k % 26]) * n for k, n in enumerate([0, 1, 2048, 50_001, 7_000_000, 300_000])]
    monkeypatch.setattr(zstandard, "train_dictionary", train_dictionary)
    compression_quality.train_dictionaries(texts + [b"bad"], [1] * len(texts) + [0])
    assert seen == [b"".join(texts), b"bad"]


@pytest.mark.parametrize("module", [toxicity, compression_quality])
def test_classifiers_without_labels_or_rows(make_docs, spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in module.classify(make_docs([(1, "a"), (2, None)]), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.classify(make_docs([]), one).collect() == []
    assert len(module.classify(make_docs([(1, "a b c"), (1, "a b c")]), one).collect()) == 2


def test_sample_leaves_out_what_is_held_out(make_docs, spark):
    docs = make_docs([(i, "t") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    picked = labelled.sample(docs, labels, "quality", 5, 0, 50).collect()
    assert len(picked) == 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] < 200 for r in picked)


def test_sample_holds_a_repeated_id_once(make_docs, spark):
    rows = [(i, f"text {i}") for i in range(20)] + [(1, f"other {k % 3}") for k in range(500)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    found = [labelled.sample(make_docs(rows).repartition(n), labels, "toxic", 4, 2, 100).collect() for n in (1, 7)]
    ids = [r["doc_id"] for r in found[0]]
    assert 1 in ids and len(ids) == len(set(ids)) and len(ids) > 10
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1]))
    assert all(bytes(r["text"]).decode() == f"text {r['doc_id']}" for r in found[0] if r["doc_id"] != 1)
    assert all(r["y"] == r["doc_id"] % 2 for r in found[0])


def test_features_do_not_cross_texts():
    hasher = toxicity.ByteHash()
    alone = [set(toxicity.features([t], hasher)[1].tolist()) for t in (b"One two three", b"", b"four, FIVE")]
    owner, slot = toxicity.features([b"One two three", b"", b"four, FIVE"], hasher)
    assert [set(slot[owner == k].tolist()) for k in range(3)] == alone


# --- WARC ----------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "own", "own") for i, u, h in rows],
                                 "page_id long, url string, html string, payload string, hash string")


PAGES = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, "same"), (4, "u", None), (2, "u", ""), (7, "u", "é" * 50_000),
         (8, "u", "one\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (None, "u", "only null"), (11, "u", "twice"), (11, "u", "twice")]


def archived(spark, tmp_path_factory, rows, least=0):
    path = f"file://{tmp_path_factory.getbasetemp()}/warc-{uuid.uuid4().hex}"
    warc.write_archive(warc.page_records(pages_of(spark, rows), least), path)
    return path


@pytest.mark.parametrize("least", [0, 4, 5])
def test_archive_of_odd_pages(spark, tmp_path_factory, least):
    path = archived(spark, tmp_path_factory, PAGES, least)
    found = sorted((tuple(r) for r in warc.page_results(warc.read_archive(spark, path)).collect()), key=repr)
    expected = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        alike = [j for j, _, h in PAGES if (h or "").encode() == payload and j is not None]
        first = min(alike, default=None)
        again = len(payload) >= least and i != first
        expected.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                         "revisit" if again else "response", first if again else None))
    assert found == sorted(expected, key=repr)


def test_pages_of_a_hot_payload_meet_their_first_in_many_tasks(spark, small_partitions):
    rows = [(i, f"u{i}", prose(i, 60)) for i in range(40)] + [(i, f"u{i}", prose(99, 120)) for i in range(40, 2040)]
    out = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
    found = out.select("record_type", "refers_to").collect()
    assert sum(r["record_type"] == "response" for r in found) == 41
    assert {r["refers_to"] for r in found if r["record_type"] == "revisit"} == {"<urn:x-page:40>"}
    out = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_archive_of_no_pages(spark, tmp_path_factory):
    assert warc.read_archive(spark, archived(spark, tmp_path_factory, [])).collect() == []


def test_filters_reach_the_headers(spark, tmp_path_factory):
    df = warc.read_archive(spark, archived(spark, tmp_path_factory, PAGES))
    whole = df.collect()
    for condition in ("record_type = 'revisit'", "refers_to is null", "record_type <> 'response'", "target_uri like 'http%'",
                      "record_id in ('<urn:x-page:5>', '<urn:x-page:7>')", "not target_uri = 'u'", "target_uri <=> null"):
        local = spark.createDataFrame(whole, df.schema).where(condition).collect()
        assert sorted(map(repr, df.where(condition).collect())) == sorted(map(repr, local)), condition
    assert all(r["payload"] is None for r in warc.read_archive(spark, archived(spark, tmp_path_factory, PAGES), payload=False).collect())


def test_header_predicates_decide_what_is_read():
    records = [warc.record_bytes({"WARC-Type": t, "WARC-Record-ID": f"<{k}>"}, b"x" * n)
               for k, (t, n) in enumerate([("response", 0), ("revisit", 9000), ("response", 200_000), ("metadata", 3)])]
    for data in (b"".join(records), b"".join(map(warc.member, records)), b"".join(zlib.compress(r, wbits=31) for r in records)):
        source = pa.BufferReader(data)
        seen = list(warc.read_records(source, lambda h: True if h["warc-type"] == "response" else False if h["warc-type"] == "metadata" else None))
        assert [(r.headers["warc-record-id"], None if r.payload is None else len(r.payload)) for r in seen] == [
            ("<0>", 0), ("<2>", 200_000), ("<3>", None)]
    reader = warc.WarcReader({"path": "/"})
    kept = list(reader.pushFilters([EqualTo(("record_type",), "x"), EqualTo(("payload",), b""), Not(IsNull(("date",))),
                                    In(("target_uri",), ("a", None)), Not(StringStartsWith(("record_id",), "<"))]))
    assert kept == [EqualTo(("payload",), b""), In(("target_uri",), ("a", None))]
    assert len(reader.filters) == 3


# --- top-k ---------------------------------------------------------------------------------


def best_by_hand(vectors, k, every):
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for place, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for other, (j, w) in enumerate(usable) if other != place)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [topk.SHARD, 16])
def test_top_k_against_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.2]) for i in range(120)]
    vectors += [(200 + i, vectors[3][1]) for i in range(7)] + [(300, [0.0] * 8), (301, [-1.0] * 8)]
    vectors += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in vectors], "vec_id long, embedding array<float>, score string, rank int")
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, shard=shard, block=7)
    assert sorted(tuple(r) for r in found.collect()) == best_by_hand(vectors, 5, 10)


def test_top_k_of_large_components(spark):
    vectors = [[3e12, 1.0], [1.0, -2.0], [2.0, 5.0], [1e6, 1e6], [float("inf"), 1.0], [float("nan"), 1.0], [-3e12, 0.5]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = topk.top_k(rows, F.col("vec_id").isin(1, 2), k=4).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in enumerate(vectors) if i not in (4, 5)}
    for q in (1, 2):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:4]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q) == [
            (n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    # The bound is too large for 64 bits, the scores found are not.
    wide = topk.Postings(np.arange(3), np.arange(3), np.array([[1 << 60, 0], [-(1 << 60), 1], [3, 4]]))
    ids, scores = wide.best(0, np.array([1 << 60, 0]), 1)
    assert (ids.tolist(), scores.tolist()) == ([2], [3 << 60])
    with pytest.raises(OverflowError):
        wide.best(1, np.array([1 << 60, 0]), 1)


class Counted(np.ndarray):
    """Counts the places that are multiplied."""

    places = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        out = getattr(ufunc, method)(*[np.asarray(x) for x in inputs], **options)
        Counted.places += np.size(out) if ufunc is np.multiply else 0
        return out


@pytest.mark.parametrize("filled", [3, 30])
def test_top_k_scores_along_the_postings(filled):
    rng = np.random.default_rng(filled)
    matrix = np.zeros((3000, 64), np.int64)
    for row in matrix:
        row[rng.choice(64, filled, replace=False)] = rng.integers(-300, 300, filled)
    postings = topk.Postings(np.arange(3000), np.arange(3000), matrix.copy())
    postings.matrix = postings.matrix.view(Counted)
    Counted.places = 0
    for own in range(40):
        ids, scores = postings.best(own, matrix[own], 5)
        full = matrix @ matrix[own]
        best = [i for i in np.lexsort((np.arange(3000), -full)) if i != own][:5]
        assert ids.tolist() == best and scores.tolist() == full[best].tolist()
    if filled == 3:  # the first probe reads one column of 3000, the postings hold about 70 places each
        assert Counted.places / 40 < 4000


@pytest.mark.parametrize("shard", [topk.SHARD, 5])
def test_top_k_of_repeated_ids(spark, shard):
    """Every row of an id is a query and a candidate; only the row itself is left out."""
    vectors = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (0, [0.5, 0.5])] + [(i, [i / 40, 1 - i / 40]) for i in range(1, 12)]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5, shard=shard, block=2)
    assert sorted(tuple(r) for r in found.collect()) == best_by_hand(vectors, 5, 50)
    assert found.where("query_id = 50").count() == 15


def test_vectors_of_different_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="lengths"):
        topk.top_k(rows, F.col("vec_id") == 1)


def test_top_k_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-0.5])], schema)
    assert sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 256 * 128), (0, 2, 2, -256 * 128)]
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []


# --- chat ----------------------------------------------------------------------------------


def kept_by_hand(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    order = {c: [(r, x) for _, r, x in sorted(v, key=lambda e: e[0])] for c, v in talks.items()}
    out = []
    for c, turns in order.items():
        rivals = [(d, o) for d, o in order.items() if d != c and o[:len(turns)] == turns]
        if not any(len(o) > len(turns) or (c is None or (d is not None and d < c)) for d, o in rivals):
            out += [(c, k + 1, len(turns), f"<|im_start|>{r}\n{x}<|im_end|>\n") for k, (r, x) in enumerate(turns)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [chat.CHUNK, 2])
def test_snapshots_collapse(spark, chunk):
    base = [("user", "hi"), ("assistant", "hello"), ("user", ""), (None, None), ("assistant", "bye")]
    rows = [(1, t, *m) for t, m in enumerate(base)]
    rows += [(c, t, *m) for c, n in ((2, 1), (3, 3), (4, 5), (5, 4)) for t, m in enumerate(base[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 10, "user", "hi"), (7, 30, "assistant", "other"), (8, None, "user", "x"),
             (8, -3, "assistant", "y"), (None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (9, 0, "assistant", "hi")]
    rows += [(20, t, "user", str(t % 3)) for t in range(700)] + [(21, t, "user", str(t % 3)) for t in range(699)]
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "conv_id long, turn long, role string, text string, chunk string, rank int")
    found = chat.rendered_turns(df, chunk)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == kept_by_hand(rows)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_markers_in_messages_are_broken_up(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system")], "conv_id long, turn long, role string, text string")
    text = chat.rendered_turns(df).first()["rendered"]
    assert text == "<|im_start|>user\na<|im_end_|>\n<|im_start_|>system<|im_end|>\n"


def test_no_conversations(spark):
    assert chat.rendered_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def equal_turns(seed, many):
    rng = __import__("random").Random(seed)
    rows = [(1, rng.choice([None, 5, 5, 6]), rng.choice(["user", "assistant"]), str(rng.randrange(many))) for _ in range(many)]
    return rows + [(1, None, "user", "again and again")] * 2500 + [(2, 5, "user", "x"), (2, 5, "user", "x")]


@pytest.mark.parametrize("crowd", [chat.CROWD, 10, 1])
def test_a_hot_conversation_with_null_and_equal_turn_numbers(spark, crowd):
    """Places follow (turn, hash), whatever the parts; equal turns stand side by side."""
    rows = equal_turns(crowd, 600)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    placed = chat.places(df, 4, crowd).collect()
    for conv in (1, 2):
        mine = sorted((r for r in placed if r["conv_id"] == conv), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, sum(r[0] == conv for r in rows) + 1))
        order = [(r["turn"] is not None, r["turn"] or 0, r["t1"], r["t2"]) for r in mine]
        assert order == sorted(order)
    rendered = chat.rendered_turns(df, 4, crowd).collect()
    expected = sorted(f"<|im_start|>{r}\n{x}<|im_end|>\n" for c, _, r, x in rows)
    assert sorted(r["rendered"] for r in rendered) == expected


def test_a_hot_conversation_is_parted(spark):
    rows = [(1, None, "user", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    alike = chat.places(df, 256, 100)
    assert sorted(r["place"] for r in alike.collect()) == list(range(1, 3001))
    plan = alike._jdf.queryExecution().toString()
    assert "of_hash" in plan or "part" in plan


def test_snapshots_with_equal_turn_numbers_collapse(spark):
    """Equal turns by number are ordered by their hash alone, in every conversation alike."""
    base = [(0, "user", "a"), (0, "user", "b"), (0, "user", "a"), (1, "assistant", "c")]
    rows = [(1, *m) for m in base] + [(2, *m) for m in base[:3]] + [(3, *m) for m in reversed(base)]
    found = chat.rendered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"] for r in found} == {1} and len(found) == 4


# --- classifiers, by hand ------------------------------------------------------------------


def features_by_hand(text):
    """Words, neighbours and skip-grams as strings."""
    words = "".join(c.lower() if c.isascii() else c for c in text)
    words = "".join(c if c.isalnum() and c.isascii() or not c.isascii() else " " for c in words).split()
    out = {("w", w) for w in words}
    for gap in (1, 2, 3):
        out |= {(gap, a, b) for a, b in zip(words, words[gap:])}
    return out


def ftrl_by_hand(texts, labels):
    """FTRL-proximal per coordinate, in dictionaries over string features."""
    import math

    z, n = {}, {}

    def weight(f):
        if f == "bias":
            return -z.get(f, 0.0) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA)
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for text, y in zip(texts, labels):
            active = [*features_by_hand(text), "bias"]
            own = {f: weight(f) for f in active}
            gradient = 1 / (1 + math.exp(-max(-30, min(30, sum(own.values()))))) - y
            for f in active:
                rate = (math.sqrt(n.get(f, 0.0) + gradient ** 2) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA
                z[f] = z.get(f, 0.0) + gradient - rate * own[f]
                n[f] = n.get(f, 0.0) + gradient ** 2
    return lambda text: 1 / (1 + math.exp(-max(-30, min(30, sum(weight(f) for f in {*features_by_hand(text), "bias"})))))


def labelled_prose(seed, many):
    rng = __import__("random").Random(seed)
    good, bad = "calm river stone meadow light über".split(), "rotten vile hateful filth scum".split()
    rows = []
    for i in range(many):
        y = rng.random() < 0.4
        rows.append((i, " ".join(rng.choice((good + bad) if y else good) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(3, 25))), int(y)))
    return rows


def test_toxicity_like_ftrl_by_hand(spark, make_docs):
    rows = labelled_prose(3, 300)
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]
    hasher = toxicity.ByteHash()
    slots = {}
    for text in texts:  # no two features share a slot here, so the comparison is exact
        found = set(toxicity.features([text.encode()], hasher)[1].tolist())
        assert len(found) == len(features_by_hand(text))
        for f in features_by_hand(text):
            slots.setdefault(f, set(found)).intersection_update(found)
    model = toxicity.train([t.encode() for t in texts], labels)
    by_hand = ftrl_by_hand(texts, labels)
    more = texts + [t for _, t, _ in labelled_prose(4, 50)] + ["", "scum"]
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(list(enumerate(more))), model).collect()}
    assert len(model.slots) > 3
    assert all(abs(scored[i] - by_hand(t)) < 1e-5 for i, t in enumerate(more))


def test_quality_like_compression_by_hand(spark, make_docs):
    """Sizes from direct calls of the library, block by block; the curve by a plain search for its largest likelihood."""
    import math

    import zstandard

    rows = labelled_prose(5, 400)
    good, bad = compression_quality.train_dictionaries([t.encode() for _, t, _ in rows[:200]], [1 - y for *_, y in rows[:200]])

    def size(content, text):
        packer = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content),
                                          write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(text[at:at + 2048])) for at in range(0, len(text), 2048))

    long = " ".join(t for _, t, _ in rows)
    texts = [t for _, t, _ in rows[200:]] + ["", long, "x"]
    differences = []
    for text in texts:
        a, b = size(good, text.encode()), size(bad, text.encode())
        differences.append((b - a) / (a + b) if a + b else 0.0)
    x, y = np.array(differences[:200]), np.array([1 - y for *_, y in rows[200:]])
    curve = compression_quality.logistic(x, y)
    loss = lambda i, s: float(np.sum(np.log1p(np.exp(i + s * x)) - y * (i + s * x)))
    assert all(loss(*curve) <= loss(curve[0] + di, curve[1] + ds) + 1e-2 for di in (-0.3, 0, 0.3) for ds in (-5, 0, 5))
    model = compression_quality.Model(good, bad, *curve)
    docs = make_docs(list(enumerate(texts)))
    found = {r["doc_id"]: r for r in compression_quality.score(docs, model).collect()}
    for i, d in enumerate(differences):
        assert abs(found[i]["score"] - 1 / (1 + math.exp(-max(-30, min(30, curve[0] + curve[1] * d))))) < 1e-9
    kept = compression_quality.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["score"] >= 0.5}


# --- packing: equal items, bounded memories ------------------------------------------------


def test_many_equal_pieces_are_packed_at_once():
    import time

    lengths = np.array([1100] * 19_000 + [1] * 900)
    started = time.monotonic()
    sequence, _ = packing.pack_lengths(lengths, 2048)
    assert time.monotonic() - started < 5 and len(set(sequence.tolist())) == 19_000


@pytest.mark.parametrize("seed", range(4))
def test_packing_leaves_no_gaps_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2048 if seed % 2 else 900, 3000)
    sequence, offset = packing.pack_lengths(lengths, 2048)
    fills = np.bincount(sequence, lengths).astype(int)
    assert fills.max() <= 2048 and lengths.sum() == fills.sum()
    for number in range(0, len(fills), 97):
        own = np.flatnonzero(sequence == number)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
    best = packing.best_fit(lengths, 2048)
    assert len(fills) <= len(best)


def test_a_tasks_words_are_bounded_in_bytes(monkeypatch):
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    small, free = packing.WordTokenizer(path), None
    texts = [prose(i, 200).encode() for i in range(40)]
    monkeypatch.undo()
    free = packing.WordTokenizer(path)
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    for text in texts:
        assert small.ids(text) == free.ids(text)
        assert small._held <= 20_000 + 200 * 300


def test_latin_texts_are_parted_without_the_library():
    """Marks, digits and contractions too: the library's way to a word's ids costs several times the model's."""
    library = tokenizers.Tokenizer.from_file(BPE)
    rng = random.Random(12)
    signs = [chr(c) for c in range(256)] + ["'s", "'LL", "'re", "..", "ab", "\u00e9t\u00c9", " "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(2000)] + ["Anthou.%%% it's 42, caf\u00c9!? don''t ..'s"]
    texts = [t for t in texts if "<|" not in t]
    own = packing.WordTokenizer(BPE)
    own._tokenizer = None
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_beyond_latin_and_other_tokenizers_equal_the_library(tmp_path):
    rng = random.Random(13)
    signs = list("abAB1'.\u2019\u0130\u03a3\u4e2d\u0301\u00e9 \x1c\x85\xa0\u3000") + ["'s", "<|endoftext|>", "<|", " "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(1000)] + ["Reorly, it's caf\u00c9 (42)."]
    library = tokenizers.Tokenizer.from_file(BPE)
    library.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([
        tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.save(str(tmp_path / "whole_words.json"))
    for path in (BPE, str(tmp_path / "whole_words.json")):
        own, library = packing.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
        for text in texts:
            assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_of_the_tokenizing_operators(spark, make_docs):
    import sentencepiece

    text = ("The quick brown fox, é jumps. " + prose(1, 50) + " ") * 20_000  # some 8 MB
    docs = make_docs([(1, text), (2, None), (3, "short")])
    path = __import__("public_tokenizers").path
    ids = {r["doc_id"]: r["ids"] for r in sentencepieces.encode(docs, path("piece_bpe_32k.model")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    assert np.frombuffer(ids[1], "<u4").tolist() == library.encode(text)
    pieces = [r for r in packing.token_pieces(docs, path("word_bpe_49k.json")).collect() if r["doc_id"] == 1]
    assert len(pieces) > 100 and sum(r["length"] for r in pieces) % 20_000 == 1
    scored = toxicity.score(docs, toxicity.Model(np.array([5]), np.array([0.5]), 0.0)).collect()
    assert len(scored) == 3 and all(0 <= r["score"] <= 1 for r in scored)


def test_arrow_opens_paths_of_hadoops_connectors():
    assert warc.arrow_uri("s3a://bucket/x/y") == "s3://bucket/x/y" and warc.arrow_uri("/x") == "/x"
    assert warc.arrow_uri("wasbs://c@a.blob.core.windows.net/x") == "abfss://c@a.dfs.core.windows.net/x"
    assert warc.arrow_uri("file:/x") == "file:///x" and warc.arrow_uri("hdfs://n:1/x") == "hdfs://n:1/x"
