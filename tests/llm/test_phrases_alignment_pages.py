"""Collocations and alignment against brute force; pages against texts known beforehand."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from veilwright.llm import alignment, collocations, queries, sitetree

from samples import prose

# --- collocations --------------------------------------------------------------------------


def phrases_by_hand(rows, support, most):
    """`rows` of (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    covered = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (lang, words[i:i + m])
                if 100 * a >= 80 * candidates[inner]:
                    covered.add(inner)
    out = []
    for lang in n:
        ranked = []
        for (own, words), a in candidates.items():
            if own == lang and (own, words) not in covered:
                score, _, left, right = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                                            for k in range(1, len(words)))
                ranked.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def lang_docs(spark, rows):
    """Documents with further columns, named like the operator's own."""
    schema = "doc_id long, lang string, text string, phrase string, key string, n string, a string"
    return spark.createDataFrame([(i, lang, text, "own", "own", "own", "own") for i, (lang, text) in enumerate(rows)], schema)


def phrase_rows(seed, many):
    rng = random.Random(seed)
    words = ["a", "b", "c", "D", "é", "long-word", "\x00", "x" * 30]
    blanks = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]
    rows = []
    for _ in range(many):
        text = "".join(rng.choice(words) + rng.choices(blanks, [20, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), text))
    return rows


@pytest.mark.parametrize("block", [150, 4000, collocations.BLOCK])
@pytest.mark.parametrize("support", [3, 30])
def test_phrases_like_by_hand(spark, block, support):
    rows = phrase_rows(block + support, 120) + [("en", None), ("en", ""), (None, " \t . "), ("de", "A b c")] + [("fr", "un deux trois")] * 40
    found = collocations.collocations(lang_docs(spark, rows), support, 25, block)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == phrases_by_hand(rows, support, 25)


def test_phrases_of_a_long_text_are_counted_over_block_borders(spark):
    rows = [("en", "one two three four five, " * 400_000), ("en", "one two " * 3)]  # 10 MB
    found = collocations.collocations(lang_docs(spark, rows), 30, 10).collect()
    assert sorted(map(tuple, found)) == phrases_by_hand(rows, 30, 10)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(lang_docs(spark, []).limit(0)).collect() == []
    assert collocations.collocations(lang_docs(spark, [("en", None), (None, "")])).collect() == []


def test_a_shard_hides_no_more_than_the_support_allows(spark):
    """Occurrences dealt over all shards: 30 make a phrase, 29 do not, and no shard has more than a few of them."""
    rows = [("en", "p q. " + prose(i, 40)) for i in range(30)]
    for many in (29, 30):
        docs = lang_docs(spark, rows[:many]).repartition(12)
        found = collocations.collocations(docs, 30, 2000, 300).collect()
        assert ("p q" in {r["phrase"] for r in found}) == (many == 30)


def test_bit_sets_hold_all_that_was_put_in(spark):
    values = spark.range(0, 5000).selectExpr("xxhash64(id) AS key")
    for bits in (1 << 16, 1 << 27):
        found = collocations.BitSet.of(values, "key", bits)
        keys = [r["key"] for r in values.collect()]
        assert found.holds(np.array(keys, np.int64).view(np.uint64)).all()


# --- alignment -----------------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = alignment.letters_of_bytes()
    out, counts = [], Counter()
    for i, text in rows:
        links, record = [], (i, 0, 0, 0, "")
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            bytes_a = [bytes(letters[c] for c in first.id_to_token(t)) for t in a]
            pieces = [second.id_to_piece(t) for t in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(t) else p.replace("▁", " ").encode() for t, p in zip(b, pieces)]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                ends = []
                for side in (bytes_a, bytes_b):
                    at, own = 0, {}
                    for place, token in enumerate(side):
                        at += len(token)
                        own[at] = place
                    ends.append(own)
                groups, pa, pb = [], 0, 0
                for cut in sorted(set(ends[0]).intersection(ends[1])):
                    to_a, to_b = ends[0][cut] + 1, ends[1][cut] + 1
                    groups.append(",".join(map(str, a[pa:to_a])) + "|" + ",".join(map(str, b[pb:to_b])))
                    links.append((a[to_a - 1], b[to_b - 1]))
                    pa, pb = to_a, to_b
                record = (i, len(a), len(b), len(groups), ";".join(groups))
        counts.update(links)
        out.append((record, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted([(*r[:3], r[3], len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), r[4])
                   for r, links in out], key=repr)


def align_all(docs):
    rows = alignment.with_counts(alignment.align(docs, A, B), A, B).select("doc_id", "n_a", "n_b", "n_links", "n_links", "n_best", "count_sum", "groups").collect()
    return sorted(map(tuple, rows), key=repr)


def test_alignment_of_odd_rows(make_docs, messy):
    rows = messy + [(50, "▁"), (51, "a ▁ b"), (52, "<|endoftext|></s><0x41>"), (53, "日本語のテキスト 🙂🙂"), (54, "  x  y\r\n\r\n z"),
                    (55, "é ﬁ Å"), (56, " "), (57, "'s 're 12345 6"), (58, "a" * 3000)]
    assert align_all(make_docs(rows)) == aligned_by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_alignment_of_random_texts(make_docs, seed):
    rng = random.Random(seed)
    signs = "abcdefghijklmnop     \n\t.,'éßüñ日🙂123<>|▁\x00"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(400)))) for i in range(60)]
    assert align_all(make_docs(rows)) == aligned_by_hand(rows)


def test_remembered_units_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "x", " ", "  ", "é", "12 ", "don't ", "\n", "Über ", "\x1f ", "\u3000", "▁"][:11 + (i % 9 == 0)])
                     for _ in range(200)) for i in range(60)]
    expected = aligned_by_hand(list(enumerate(texts)))
    for most, word in ((200_000, 1 << 16), (3, 4)):
        monkeypatch.setattr(alignment, "REMEMBERED", most)
        monkeypatch.setattr(alignment, "WORD", word)
        aligner = alignment.Aligner(A, B)
        found = []
        for at in range(0, 60, 7):
            sides, links = aligner.align(texts[at:at + 7])
            found += zip(aligner.groups(sides, links), (sides[0][1][1:] - sides[0][1][:-1]).tolist(), strict=True)
        assert [(i, *f) for i, f in enumerate(found)] == sorted((r[0], r[7], r[1]) for r in expected)


def test_lockstep_does_not_depend_on_the_stride():
    rng = random.Random(1)

    def ends(total):
        return np.array(sorted(set(rng.sample(range(1, total), total // 3)) | {total}))
    a, b = ends(5000), ends(5000)
    expected = sorted(set(a.tolist()).intersection(b.tolist()))
    for stride in (1, 7, 1024, 10_000):
        links = alignment.lockstep(a, np.array([0, len(a)]), b, np.array([0, len(b)]), stride)
        assert a[links.a].tolist() == expected == b[links.b].tolist()


def test_a_text_of_ten_megabytes_is_aligned_whole(make_docs):
    text = "The quick brown fox, é " * 450_000
    (row,) = align_all(make_docs([(1, text)]))
    (part,) = aligned_by_hand([(1, "The quick brown fox, é " * 10)])
    per_turn = (part[3] - 1) // 10
    assert row[3] == per_turn * 450_000 + 1 and row[7].startswith(part[7].rsplit(";", 1)[0])


def test_alignment_of_nothing(make_docs):
    assert align_all(make_docs([]).limit(0)) == []


def test_alignment_query(spark, make_docs, tmp_path):
    rows = [(1, prose(1, 30)), (2, prose(1, 30)), (3, None), (3, ""), (4, "a ▁")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, queries.op13_cross_tokenizer_alignment(spark, str(tmp_path)).collect()))
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in aligned_by_hand(rows)]
    assert found == sorted(expected)


# --- pages ---------------------------------------------------------------------------------


def extracted(html, noisy=()):
    return sitetree.Page(html).text_without(set(noisy))


def test_what_markup_names_is_no_text():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header class=top>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
      <!-- <p>not this</p> --><article class="post"><header class="article-header"><h1>A &amp; B</h1></header>
      <p>One <b>two</b>
         three&nbsp;four<p>five<br>six</p><div class="share-buttons">Share</div><pre> a
      b </pre><form><input><button>Send</button></form><ul><li>x<li>y</ul><section id="comments"><p>First!</p></section></article>
      <aside>Side</aside><div id="sidebar"><p>More</p></div><div class="ad">Buy</div><footer>&copy;</footer></body></html>"""
    assert extracted(html) == "A & B\nOne two three four\nfive six\na b\nx\ny"


def test_broken_markup():
    assert extracted("") == ""
    assert extracted("plain &lt;text&gt; &am") == "plain <text> &am"
    assert extracted("<p>a<p>b<div>c</p>d") == "a\nb\nc\nd"
    assert extracted("<article><p>a</p><script>x") == "a"
    assert extracted("<article><p>a <i>b</p>c</i> d") == "a b\nc d"
    assert extracted("<p>1 < 2 and <b class='x>y</b> z") == "1 < 2 and y z"
    assert extracted("<div class='no-sidebar content'>text</div>") == "text"
    assert extracted("<article><h1>t</h1></article><div>beside</div>") == "t"
    assert extracted("<div>a</div><!-- open") == "a"
    assert extracted("<TABLE><tr><td>a<td>b<tr><td>c</TABLE>") == "a\nb\nc"


def test_deep_and_long_pages():
    assert extracted("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert extracted("<span>" * 50_000 + "deep") == "deep"
    long = "word " * 2_000_000
    assert extracted(f"<article><p>{long}</p></article>") == long.strip()
    assert len(extracted("<article>" + "<p>x &amp; y" * 500_000)) == 6 * 500_000 - 1


def site_pages(seed, many, host="site.example"):
    """Pages of a site whose markup names nothing: a menu, a teaser box and a foot that all pages share, and own text."""
    rng = random.Random(seed)
    rows = []
    for i in range(many):
        own = [prose(rng.randrange(10**9), rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in own)
        html = (f"<html><body><div class=m1><span>Start</span> <span>Imprint</span></div><div class=c1>{body}</div>"
                f"<div class=t1><p>Read more of us</p><p>Every day new</p></div><div class=f1>Foot of {host}</div></body></html>")
        rows.append((rng.randrange(10**6), f"http://{host}/{i}?x={i}", html, "\n".join(own)))
    return rows


def page_table(spark, rows):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in ("host", "page", "key", "text", "noisy", "nodes")]])
    return spark.createDataFrame([(*r[:3], *["own"] * 6) for r in rows], schema)


def test_a_site_without_names_loses_what_its_pages_share(spark):
    rows = site_pages(1, 12)
    found = {r["page_id"]: r for r in sitetree.main_text(page_table(spark, rows)).collect()}
    assert {i: r["text"] for i, r in found.items()} == {r[0]: r[3] for r in rows}
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_few_pages_of_a_host_decide_nothing(spark):
    rows = site_pages(2, 2)
    for r in sitetree.main_text(page_table(spark, rows)).collect():
        assert "Imprint" in r["text"] and "Foot of" in r["text"]


def test_copies_of_pages_and_articles_lose_nothing(spark):
    """Equal pages are merged once; near copies keep their articles."""
    own = site_pages(3, 6)
    copies = [(i, own[0][1], own[0][2], own[0][3]) for i in range(2_000_000, 2_000_300)]
    article = "".join(f"<p>{prose(k, 30)}</p>" for k in range(4))
    near = [(3_000_000 + i, f"https://near.example/{i}", f"<html><body><article>{article}<p>{prose(100 + i, 8)}</p></article></body></html>",
             "\n".join([*(prose(k, 30) for k in range(4)), prose(100 + i, 8)])) for i in range(8)]
    rows = own + copies + near
    found = {r["page_id"]: r["text"] for r in sitetree.main_text(page_table(spark, rows)).collect()}
    assert found == {r[0]: r[3] for r in rows}


def test_odd_pages(spark):
    rows = [(None, None, None, ""), (1, None, "", ""), (1, "no url", "<p>a", "a"), (2, "http://h.example", None, ""),
            (2, "http://h.example", None, ""), (None, "HTTP://U@H.example:80/x", "<p>b</p>", "b")]
    found = sitetree.main_text(page_table(spark, rows)).collect()
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found), key=repr) == sorted(
        ((i, u, t, len(t)) for i, u, _, t in rows), key=repr)
    assert sitetree.main_text(page_table(spark, []).limit(0)).collect() == []


def test_importance_by_hand(spark):
    """Four pages: a box with the same text on all, one with the same text on two of four, one that always differs."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class=a>same</div><div class=b>{'half' if i < 2 else i}</div><div class=c>{prose(i, 9)}</div>",
             "") for i in range(4)]
    trees = sitetree.page_trees(page_table(spark, rows))
    label = {c: sitetree.Page(rows[0][2]).blocks[k].path[-1] for k, c in enumerate("abc")}
    # Entropies in the unit log 4: 1 for a; of the three texts of b 0.5, 0 and 0; 0 for c.
    composite = {"a": 0.0, "b": 1 - 0.5 / 3, "c": 1.0}
    for threshold in (0.01, 0.8, 0.84, 1.01):
        low = {r["key"] for r in sitetree.noisy_nodes(trees, threshold, 3).collect()}
        assert {c for c in "abc" if label[c] in low} == {c for c, v in composite.items() if v < threshold}


def test_the_pages_given(spark):
    """The given pages have their text in an article, beside menu, advert and footer."""
    from html import unescape

    folder = "/root/testdata/sf0.001"
    found = {r["page_id"]: r["text"] for r in queries.op11_site_style_tree(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.DOTALL)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article[1])]
        assert found[row["page_id"]] == "\n".join(p for p in parts if p)
