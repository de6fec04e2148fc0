import random
import zlib

import numpy as np
import pyarrow as pa
import regex

from wardlake.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(word, words, stems):
    near = [(distance(word, w), False) for w in words if distance(word, w) <= toxicity.allowance(w)]
    for s in stems:
        d = min((distance(word[:n], s) for n in range(1, len(word) + 1)), default=9)
        if d <= int(len(s) >= 6):
            near.append((d, True))
    return min(near, default=None)


def test_automaton_equals_edit_distance():
    own = random.Random(4)
    make = lambda n: "".join(own.choice("abcé") for _ in range(n))
    words, stems = [make(own.randint(1, 10)) for _ in range(25)], [make(own.randint(4, 7)) for _ in range(6)]
    trie, kinds = toxicity.Trie(words, stems), toxicity.Lexicon(words, stems).matcher()
    asked = ["", *words, *stems]
    for _ in range(1500):
        w = list(own.choice(words + stems))
        for _ in range(own.randint(0, 3)):
            at = own.randrange(len(w) + 1)
            w[at : at + own.randint(0, 1)] = make(own.randint(0, 1))
        asked.append("".join(w))
    want = [brute(w, words, stems) for w in asked]
    assert [trie.nearest(w) for w in asked] == want
    # The regular expressions in front of the walk lose no word.
    code = [0 if n is None else (2 if n[1] else 1) if n[0] == 0 else 2 + n[0] for n in want]
    assert kinds(pa.array(asked, pa.large_string())).tolist() == code


def test_words_are_cut_alike():
    texts = ["Ab c1,d-e  É'f", "", None, " . ", "日本 x@y $h*t", "a\nb\tc"]
    distinct, at, first = toxicity.tokens(pa.array(texts))
    got = [[distinct[int(i)].as_py() for i in at[a:b]] for a, b in zip(first[:-1], first[1:])]
    assert got == [regex.findall(toxicity.INSIDE, (t or "").lower()) for t in texts]


def test_quotation_marks():
    text = 'he "called her x" then x and\n> quoted x line\nx “x” x'
    assert toxicity.quoted_places(text, [5, 6, 8, 10, 11, 12]) == [False, False, True, False, True, False]
    assert toxicity.quoted_places(text, [3]) == [True] and toxicity.quoted_places("x", [0]) == [False]


def prose(own, extra=()):
    body = [f"{own.choice('bdfgklmnprst')}{own.choice('aeiou')}{own.choice('bdfgklmnprst')}{own.choice('aeiou')}" for _ in range(40)]
    for w in extra:
        body.insert(own.randrange(len(body)), w)
    return " ".join(body)


BAD = ["zxblockhead", "qwnitwit", "vyjerk"]


def corpus():
    own = random.Random(9)
    rows, marks = [], []
    for i in range(600):
        kind = i % 6
        if kind == 0:
            body = prose(own, own.choices(BAD, k=3))
        elif kind == 1:
            body = prose(own) + f' the reviewer reported "{own.choice(BAD)} {prose(own)[:20]} {own.choice(BAD)}" as wording'
        else:
            body = prose(own)
        rows.append((i, body))
        marks.append((i, int(kind == 0)))
    return rows, marks


def test_misspelt_quoted_and_clean(spark, sf_dir):
    rows, marks = corpus()
    own = random.Random(2)
    asked = {
        9001: prose(own, ["zxblokhead", "qwnitwitt", "zxblockheat"]),
        9002: prose(own),
        9003: None,
        9004: "",
        9005: prose(own) + f' the reviewer reported "{BAD[0]} {prose(own)[:20]} {BAD[1]}" as wording',
        9006: " ".join(prose(own) for _ in range(800)) + " zxblockhead qwnitwit vyjerk",
        9007: BAD[0],
    }
    # A large group of copies of a toxic text teaches nothing but its terms.
    copies = [(10_000 + i, prose(random.Random(1), BAD[:1] * 3) + f" c{i}") for i in range(60)]
    docs = [*rows, *asked.items(), *copies, (9001, prose(own)), (None, BAD[0]), rows[0], rows[0]]
    labels = [*marks, *((i, 1) for i, _ in copies), (None, 1), (9002, None), (0, 0)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, toxic string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, known)
    assert set(model.lexicon.words) == set(BAD) and not model.lexicon.stems
    got = toxicity.judge(frame, known).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.predicted)
    assert sorted(found[9001]) == [0, 1] and found[None] == [1] and found[0] == [1, 1, 1]
    assert [found[i] for i in range(9002, 9008)] == [[0], [0], [0], [0], [1], [1]]
    wrong = [i for i, m in marks if found[i][0] != m]
    assert len(wrong) <= 6


def test_no_labels_one_class_no_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(edge_docs, labels).collect()} == {1.0}
    assert {r.score for r in toxicity.judge(edge_docs, labels.filter("doc_id < 0")).collect()} == {0.0}
    assert toxicity.judge(no_docs, labels).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    # The smallest scale has ten toxic texts, too few to learn from.
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = ([r.predicted for r in rows if r.toxic == t] for t in (0, 1))
    assert np.mean(clean) <= 0.02 and np.mean(toxic) >= 0.7
