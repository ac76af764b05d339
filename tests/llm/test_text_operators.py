"""Substring dedup, near-duplicates, quality rules: against brute force, over odd rows and random ones."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from veilwright.llm import components, fmindex, quality_rules, simhash, substrings

from samples import prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPLIT.findall(text or "")


# --- substring dedup -----------------------------------------------------------------------


def kept_by_hand(rows, window):
    first = {}
    for i, text in rows:
        w = words_of(text)
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j:j + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        w = words_of(text)
        stay = [True] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                stay[j:j + window] = [False] * window
        out.append((i, len(w), len(w) - sum(stay), " ".join(x for x, s in zip(w, stay) if s)))
    return sorted(out, key=repr)


def dedup(df, **options):
    rows = substrings.dedup_substrings(df, **options).select("doc_id", "_sub_n_words", "_sub_n_removed", "_sub_kept").collect()
    return sorted(((r[0], r[1], r[2], bytes(r[3]).decode()) for r in rows), key=repr)


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_substrings_of_odd_rows(make_docs, messy, crowd):
    assert dedup(make_docs(messy), crowd=crowd) == kept_by_hand(messy, 50)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words_repeat_a_lot(make_docs, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("ab") for _ in range(rng.randrange(40, 160))] for _ in range(6)]
    rows = [(i, " ".join(sum((rng.choice(passages) for _ in range(rng.randrange(1, 4))), []))) for i in range(25)]
    rows.append((99, "a " * 700))
    rows.append((98, "a " * 400))
    assert dedup(make_docs(rows)) == kept_by_hand(rows, 50)


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
@pytest.mark.parametrize("repeated", [1, 2])
def test_substrings_of_a_row_repeated_often(make_docs, repeated, crowd):
    texts = {1: prose(21, 120), 2: prose(22, 30) + " " + prose(21, 120)}
    rows = [(i, texts[i]) for i in (1, 2) for _ in range(2000 if i == repeated else 1)]
    df = make_docs(rows).repartition(8)
    marked = substrings.removals(df, crowd=crowd).collect()
    assert [r["doc_id"] for r in marked] == [2]
    starts = [s["start"] for s in marked[0]["spans"]]
    assert len(starts) == len(set(starts))
    assert dedup(df, crowd=crowd) == kept_by_hand(rows, 50)


def test_substrings_of_a_hot_row_meet_their_spans_in_many_tasks(make_docs, small_partitions):
    rows = [(i, prose(i, 60)) for i in range(3, 40)] + [(1, prose(41, 120))] + [(2, prose(41, 120))] * 2000
    out = substrings.dedup_substrings(make_docs(rows).repartition(8))
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_substrings_rewrite_keeps_columns_and_untouched_texts(make_docs, messy):
    df = make_docs(messy)
    out = substrings.rewrite(df)
    assert out.columns == df.columns
    by_id = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert by_id[5]["text"] == " \n\t " and by_id[3]["text"] is None and by_id[3]["score"] == "own"
    assert by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0


def test_substrings_of_an_empty_table(make_docs):
    assert dedup(make_docs([])) == []


def test_wavelet_matrix_and_index_against_scans():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 7, 399), 0)  # a last symbol of its own, as shards have
    matrix = fmindex.WaveletMatrix(text, 7)
    for symbol in range(7):
        at = np.arange(401)
        assert (matrix.rank(np.full(401, symbol), at) == np.concatenate([[0], np.cumsum(text == symbol)])).all()
    index = fmindex.FMIndex(text, 7, 6)
    for length in range(1, 7):
        for start in range(0, 390, 13):
            pattern = text[start:start + length]
            low, high = np.array([0]), np.array([400])
            for symbol in pattern[::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            hits = [k for k in range(400 - length + 1) if (text[k:k + length] == pattern).all()]
            assert sorted(index.order[low[0]:high[0]].tolist()) == hits


# --- SimHash -------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, bits=2):
    """Smallest known id per fingerprint's component; prints is a list of (id, fingerprint)."""
    nodes = sorted({f for _, f in prints})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    ids = {}
    for i, f in prints:
        if i is not None:
            ids[find(f)] = min(i, ids.get(find(f), i))
    return sorted(((i, f, ids.get(find(f))) for i, f in prints), key=repr)


def test_near_duplicates_of_odd_rows(make_docs, messy):
    rows = simhash.near_duplicates(make_docs(messy)).collect()
    found = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows), key=repr)
    assert found == components_by_hand([(i, fingerprint_by_hand(t)) for i, t in messy])


def test_near_duplicates_of_an_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_keep_first_keeps_one_document_of_each_group(make_docs, messy):
    df = make_docs(messy)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(8) == 2 and 3 in ids and 4 not in ids and None not in ids


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_links_connect_what_brute_force_connects(spark, bits, crowd):
    rng = random.Random(bits)
    prints = set()
    for _ in range(12):  # clouds of near fingerprints, and chains that leave them
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, crowd)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits and a < b for a, b in links.collect())
    roots = dict(components.connected(links).collect())
    mine = {f & (1 << 64) - 1: roots.get(f, f) & (1 << 64) - 1 for f in signed}
    expected = {f: c for _, f, c in components_by_hand([(f, f) for f in prints], bits)}
    groups = lambda m: sorted(sorted(f for f in m if m[f] == c) for c in set(m.values()))
    assert groups(mine) == groups(expected)


def test_majorities_over_many_hashes():
    rng = np.random.default_rng(1)
    counts = np.array([1, 2, 254, 255, 256, 1000, 3])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found, at = simhash.majorities(hashes, counts), 0
    for f, n in zip(found.tolist(), counts.tolist()):
        own = hashes[at:at + n].tolist()
        assert f == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        at += n


def test_golay_code_is_perfect():
    words = np.arange(0, 1 << 23, 977)
    index = simhash.codeword_index(words)
    code = index << 11
    code = code | simhash.syndrome(code)
    assert (np.bitwise_count(code ^ words) <= 3).all() and (simhash.syndrome(code) == 0).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200)], "a long, b long")
    roots = dict(components.connected(links).collect())
    assert roots == {**{i: 0 for i in range(1, 61)}, 200: 100}


# --- quality rules -------------------------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    w = words_of(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    repeated = {k for i, g in enumerate(grams) if seen[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_counts_of_odd_rows(make_docs, messy):
    rows = messy + [(20, "a b c a b c a b c d e"), (21, "x\n\nx\n x\nx \n\n"), (22, "#*$%&|<> é#é"), (23, "w " * 200)]
    found = quality_rules.judge(make_docs(rows)).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found), key=repr)
    assert mine == sorted(((i, *counts_by_hand(t)) for i, t in rows), key=repr)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_reject_symbol_junk_and_keep_prose(make_docs):
    rng = random.Random(2)
    clean = [(i, prose(i, 120).capitalize() + ".") for i in range(80)]
    junk = [(100 + i, " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(i, 120).split())) for i in range(10)]
    df = make_docs(clean + junk)
    assert {r["doc_id"] for r in quality_rules.judge(df).where("kept").collect()} == {i for i, _ in clean}
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean}


def test_all_clean_documents_are_kept(make_docs):
    assert quality_rules.keep_good(make_docs([(i, prose(i, 90)) for i in range(40)])).count() == 40


def test_rules_on_an_empty_table(make_docs):
    assert quality_rules.judge(make_docs([])).collect() == [] and quality_rules.keep_good(make_docs([])).collect() == []


def test_counting_runs_no_python(make_docs, messy):
    plan = quality_rules.judge(make_docs(messy))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_expectation_maximisation_finds_the_rates():
    rng = random.Random(9)
    good, bad = (0.01, 0.02, 0.05), (0.9, 0.8, 0.6)
    votes = Counter()
    for _ in range(20_000):
        rates = bad if rng.random() < 0.2 else good
        votes[tuple(0 if rng.random() < 0.2 else -1 if rng.random() < r else 1 for r in rates)] += 1
    fitted = quality_rules.expectation_maximisation([(list(v), n) for v, n in votes.items()], 3)
    assert abs(fitted.good - 0.8) < 0.03
    assert all(abs(a - b) < 0.06 for a, b in zip(fitted.bad_on_good + fitted.bad_on_bad, good + bad))



# --- hashes of words -----------------------------------------------------------------------


def thue_morse(length, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(length))


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_patterned_words_and_their_mirrors_are_different(make_docs, crowd):
    """Words, and orders of words, that polynomial hashes cannot tell apart."""
    around = prose(1, 59).split()
    words = [" ".join(around[:30] + [thue_morse(n, letters)] + around[30:]) for n in (1024, 4096) for letters in ("ab", "ba")]
    orders = [" ".join(thue_morse(128, letters)) for letters in ("xy", "yx")]
    rows = list(enumerate(words + orders, 1))
    assert dedup(make_docs(rows), crowd=crowd) == kept_by_hand(rows, 50)
    assert all(removed == 0 for _, _, removed, _ in dedup(make_docs(rows[:4]), crowd=crowd))


def test_word_hashes_depend_on_all_bytes_and_the_seed():
    from veilwright.llm.batches import WordHash, word_bounds

    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in [*range(1, 40), 500, 511, 512, 513, 5000] for _ in range(20)]
    words += [w[:-1] + b"c" for w in words] + [b"c" + w[1:] for w in words] + [thue_morse(n, x).encode() for n in (512, 8192) for x in ("ab", "ba")]
    data = b" ".join(words)
    seen = {}
    for seed in (1, 2):
        hashes = WordHash(seed).slices(data, *word_bounds(data)).tolist()
        assert len(set(hashes)) == len(set(words)) and len({*zip(words, hashes)}) == len(set(words))
        seen[seed] = set(hashes)
    assert not seen[1] & seen[2]


def test_texts_of_ten_megabytes(make_docs, spark):
    """Whole long texts, one of many words and one of a single word."""
    many = prose(1, 1000) + " "
    rows = [(1, many * 1400), (2, prose(2, 60) + " " + many), (3, "z" * 10_000_000), (4, "a b c")]
    found = {r[0]: r for r in dedup(make_docs(rows))}
    assert found[1][2] == 0 and found[2][2] == 1000 and found[3][1:3] == (1, 0)
    near = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs([*rows, (5, many * 1400)])).collect()}
    assert near[5]["component_id"] == 1 and near[3]["component_id"] == 3
    judged = {r["doc_id"]: r for r in quality_rules.judge(make_docs(rows)).collect()}
    assert judged[1]["n_words"] == 1_400_000 == judged[1]["n_repeat_words"] and judged[3]["word_chars"] == 10_000_000
