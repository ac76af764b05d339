"""The corpus pipeline, stage by stage, over a small corpus with planted cases; and what is registered."""

import random
import zlib

import numpy as np
import pytest
from samples import prose

import __spark_entry__
import corpus_pipeline
from veilwright.llm import queries, simhash
from veilwright.sources.scratch import written

tokenizers = pytest.importorskip("tokenizers")


def corpus():
    """(doc_id, text, quality) and the ids that each stage must remove."""
    rng = random.Random(7)
    passage = prose(999, 70)
    rows = [(i, prose(i, rng.randrange(80, 200)) + ".", 1) for i in range(120)]
    junk = [(200 + i, " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(300 + i, 120).split()), 0) for i in range(25)]
    copies = [(400 + i, rows[3][1], 1) for i in range(6)]
    near = [(420, rows[5][1].upper(), 1)]
    shared = [(440 + i, f"{prose(500 + i, 60)} {passage} {prose(600 + i, 60)}", 1) for i in range(4)]
    odd = [(460, None, 0), (461, "", 0), (462, "few words", 1), (463, prose(1, 3) + " " + prose(2, 2500), 1)]
    return rows + junk + copies + near + shared + odd, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _ = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_what_they_say(spark, folder):
    rows, passage = corpus()
    docs = queries.load(spark, folder, "documents")
    kept, texts = [], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept.append(set(texts))
    clean = set(range(120)) | {463} | set(range(440, 444))
    assert kept[0] == clean | set(range(400, 406)) | {420}
    assert kept[1] == kept[0]
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert kept[2] == clean and all(r["component_id"] == i for i, r in prints.items())
    assert kept[3] == clean
    assert passage in texts[440] and not any(passage in texts[i] for i in (441, 442, 443))
    assert texts[441] == f"{prose(501, 60)} {prose(601, 60)}" and texts[7] == dict((i, t) for i, t, _ in rows)[7]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    library = tokenizers.Tokenizer.from_file(queries.public_tokenizer("word_bpe_49k.json"))
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in mine)
        assert sum(r["length"] for r in mine) == len(ids)


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in rows}) == 125 and len(rows) > 125


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def written_corpus(spark, path, docs, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, anchor string, start int, row struct<a: int>"
    spark.createDataFrame([(i, t, "en", "s", None, "own", "own", "own", 3, (7,)) for i, t in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written_corpus(spark, tmp_path, [], [])).collect() == []


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, no labels, further columns named like helpers: all rows keep their columns."""
    docs = [(None, prose(1, 90)), (None, None), (1, prose(2, 90)), (1, prose(2, 90)), (1, prose(3, 90)), (2, None), (3, ""), (4, prose(2, 90)),
            (5, prose(4, 3000))]
    folder = written_corpus(spark, tmp_path, docs, [(None, 1, 1), (1, None, None)])
    table = queries.load(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, folder), name)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp", "anchor", "start", "row"]
        assert all(r["score"] == "own" and r["start"] == 3 and r["row"]["a"] == 7 for r in table.collect())
    ids = sorted((r["doc_id"] for r in table.collect()), key=repr)
    assert ids == [1, 1, 1, 5, None]  # 4 is a copy of 1; the rows of 1 stay together
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r["doc_id"] for r in rows}, key=repr) == [1, 5, None]


def test_run_leaves_only_what_its_result_reads(spark, folder):
    from veilwright.sources.scratch import run_folder

    files = spark._jvm.org.apache.hadoop.fs.Path
    with run_folder(spark, "check") as root:
        n = corpus_pipeline.run(spark, folder).count()
        place = files(root)
        left = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
        # The last stage's input and its pieces.
        assert n > 100 and len(left) == 2
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
