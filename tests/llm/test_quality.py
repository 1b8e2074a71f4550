import collections
import re

from vulntide.llm.quality import apply_rules

WORDS = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    number = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if number[w] > 1 for j in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), again, len(covered), failed


def test_base_figures_match_brute_force(odd_docs, documents, no_docs):
    for docs in (odd_docs, documents):
        for row in apply_rules(docs).collect():
            got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
            assert got == base(row.text), row.text
            assert not (row.base_failed and row.kept)
    assert apply_rules(no_docs).count() == 0


def test_lines_are_judged_before_the_document(spark):
    prose = [" ".join(f"word{k}x{j}" for j in range(11)) + "." for k in range(6)]
    cases = {
        "clean": (prose, True, prose),
        "licence": (prose + ["Licensed under the Apache License, Version 2.0."], True, prose),
        "menu": (["Home | News | Sport | Weather | Travel |"] + prose, True, prose),
        "mostly menu": ([f"Home{k} | News{k} | Sport{k} | Travel{k} | Money{k} | Life |" for k in range(9)] + prose[:2], False, None),
        "symbols": ([f"word{k}*** other{k}$$$ thing{k}### that&&& here%%% more*** words$$$ again{k}###." for k in range(9)] + prose[:1], False, None),
        "shouting": ["BUY THIS%d THING NOW%d AND SAVE%d A LOT OF MONEY%d TODAY NUMBER %d!!" % (k, k, k, k, k) for k in range(20)],
        "no end": (prose + ["a line that just stops without an"], True, prose),
        "cut off": (prose + ["A sentence. And one that is cut off at"], True, prose + ["A sentence. And one that is cut off at"]),
        "short with a licence": (["Few words here."] + ["This work is licensed under the GNU General Public License, version 3."], True, ["Few words here."]),
        "licence alone": (["This work is licensed under the GNU General Public License, version 3."], False, None),
        "wide end": (prose + ["これは 日本語 の 文 です。"], True, prose + ["これは 日本語 の 文 です。"]),
    }
    cases["shouting"] = (cases["shouting"], False, None)
    rows = [(k, "\n".join(lines)) for k, (lines, _, _) in cases.items()]
    out = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, (_, kept, left) in cases.items():
        assert out[name].kept is kept, name
        if left:
            assert out[name].clean_text == "\n".join(left), name


def judged(spark, cases):
    rows = [(k, "\n".join(lines)) for k, lines in cases.items()]
    return {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


def test_only_the_sentence_of_a_notice_is_cut(spark):
    words = lambda n: " ".join(f"word{n}x{k}" for k in range(n))
    out = judged(spark, {
        "paragraph": [f"{words(30)}. Read our privacy policy. {words(9)} end."],
        "mention": [f"{words(40)} what the terms of service of the firm said then."],
    })
    assert out["paragraph"].kept and out["paragraph"].clean_text == f"{words(30)}. {words(9)} end."
    assert out["paragraph"].lost_words == 4
    assert out["mention"].kept and out["mention"].clean_text == out["mention"].text


def test_notices_count_as_loss_but_for_one(spark):
    notices = [f"All rights reserved by owner{k} of part{k} and his heirs{k} there{k}." for k in range(18)]
    out = judged(spark, {
        "notices": notices + ["Hi."],
        "one line": [" ".join(notices) + " Hi."],
        "one of them": notices[:1] + ["Hi."],
    })
    assert not out["notices"].kept and not out["one line"].kept
    assert out["one of them"].kept and out["one of them"].clean_text == "Hi."


def test_menus_without_separators_are_cut(spark):
    prose = [" ".join(f"word{k}x{j}" for j in range(11)) + "." for k in range(3)]
    down = ["Home", "Products", "", "About us", "Our team here", "Contact"]
    out = judged(spark, {
        "down": [f"{name}{k}" for k in range(40) for name in down if name],
        "down and prose": down + prose,
        "along": ["Home, News, Sport, Weather", "(Home) (News) (Sport) (Our weather)"] + prose,
        "heading": ["The title", "A. Author"] + prose + ["He bought eggs, some milk, bread and a book, then"],
    })
    assert not out["down"].kept
    assert out["down and prose"].kept and out["down and prose"].clean_text == "\n".join(["", *prose])
    assert out["along"].kept and out["along"].clean_text == "\n".join(prose)
    assert out["heading"].kept and out["heading"].clean_text == out["heading"].text


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = apply_rules(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"]).join(labels, "doc_id").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.99 * len(bad)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("x", 1, "one two")], "kept string, N_WORDS int, text string")
    (row,) = apply_rules(docs).collect()
    assert row.n_words == 2 and row.kept is False and row.clean_text == "one two"
