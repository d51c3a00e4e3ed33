import random

from carelens.llm import line_templates as L

SCHEMA = "doc_id long, text string"


def corpus(n=40):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        body = [" ".join(f"{rng.choice('abcdefghij')}{chr(97 + rng.randint(0, 25))}x" for _ in range(9)) for _ in range(4)]
        lines = body[:2] + [f"Page {i} of {n} shown here"] + body[2:] + (["Terms apply"] if i % 2 else [])
        rows.append((i, "\n".join(lines)))
    return rows


def test_variable_fields_and_first_holder(spark):
    rows = corpus()
    out = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text in rows:
        gone = [x for x in text.split("\n") if (x.startswith("Page") and i > 0) or (x == "Terms apply" and i > 1)]
        assert out[i].n_dropped == len(gone)
        assert out[i].kept_text == "\n".join(x for x in text.split("\n") if x not in gone)
    found = L.line_templates(spark.createDataFrame(rows, SCHEMA)).select("template").distinct().collect()
    assert {r.template for r in found} == {"Page <*> of <*> shown here", "Terms apply"}


def test_copies_are_not_templates(spark):
    rows = corpus(1) * 30
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert all(r.n_dropped == 0 for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())


def unlike(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30)) for _ in range(n)]


def test_copies_of_a_holder_do_not_hide_a_footer(spark):
    texts = [x + "\nAll rights of this site reserved" for x in unlike(1, 21)]
    rows = list(enumerate(texts[:20])) + [(100 + i, texts[20]) for i in range(180)]
    out = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0].kept_text == texts[0]
    assert all(out[d].kept_text == t.split("\n")[0] for d, t in rows[1:])


def test_pages_that_share_more_than_they_own(spark):
    menu = "\n".join(unlike(2, 4)[i][:100 + i] for i in range(4))
    texts = [f"{x}\n{menu}" for x in unlike(3, 40)]
    out = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA), min_docs=30).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 4 for i in range(1, 40))


def test_near_copies_are_not_templates(spark):
    base = " ".join(unlike(4, 6)).split()
    rows = []
    for i in range(60):
        words = list(base)
        words[3 * i] = "changed"
        rows.append((i, "\n".join(" ".join(words[j:j + 30]) for j in range(0, 180, 30))))
    assert all(r.n_dropped == 0 for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())


def test_texts_of_one_id_are_told_apart(spark):
    rows = corpus()
    rows += [(7, "one line only"), (8, "another\n\nPage 8 of 40 shown here"), (0, "Page 8 of 41 shown here")]
    out = L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_dropped for r in out if r.doc_id == 7) == [0, 2]
    assert [r.kept_text for r in out if r.doc_id == 8 and r.text.startswith("another")] == ["another\n"]
    assert sorted(r.n_dropped for r in out if r.doc_id == 0) == [0, 1]


def test_wide_leaves_are_parsed_deeper(spark):
    rows = corpus()
    extra = [(100 + i, "same first words " + " ".join(f"{chr(97 + (i * 7 + j) % 26)}{chr(97 + i % 26)}" for j in range(6)))
             for i in range(60)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    few = sorted(map(tuple, L.line_dedup(df, leaf_lines=5).collect()))
    assert few == sorted(map(tuple, L.line_dedup(df).collect()))


def test_wide_leaves_give_the_templates_of_the_whole_leaf(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, f"{words[2 * i]} {words[2 * i + 1]}\nArticle shared by user {words[i]} with friends and family")
            for i in range(60)]
    # the same leaf: lines that form no template, and a rare one that hash parts tear apart
    rows += [(100 + i, "Article shared by " + " ".join(words[200 + (7 * i + j) % 150] for j in range(6)))
             for i in range(60)]
    rows += [(200 + i, f"Article shared by us all {words[300 + i]} on this day") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, L.line_templates(df).collect()))
    assert {t[2] for t in whole} == {"Article shared by user <*> with friends and family",
                                          "Article shared by us all <*> on this day"}
    assert len(whole) == 72
    for leaf_lines in (4, 30):
        assert sorted(map(tuple, L.line_templates(df, leaf_lines=leaf_lines).collect())) == whole


def test_parse_leaf():
    lines = [x.split() for x in ("a b c one x", "a b c two x", "q r s t u", "a b c one x")]
    got = [" ".join(t) for t in L.parse_leaf(lines, 0.7)]
    assert got == ["a b c <*> x", "a b c <*> x", "q r s t u", "a b c <*> x"]


def test_odd_rows(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "\n \n\t"), (None, "Terms apply"), (5, corpus()[5][1]),
                       (1003, "\n".join(f"z{i} unique" for i in range(3000)))]
    df = spark.createDataFrame([(d, t, "mine") for d, t in rows], SCHEMA + ", n_dropped string")
    out = L.line_dedup(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1000].kept_text is None and by[1001].kept_text == "" and by[1002].kept_text == "\n \n\t"
    assert by[None].kept_text == "Terms apply" and by[None].n_dropped == 0
    assert sum(r.doc_id == 5 and r.n_dropped == 2 for r in out) == 2
    assert L.line_dedup(df.limit(0)).count() == 0


def test_lines_of_300_words_join_by_all_positions():
    one = ["w"] * 300
    far, near = ["w"] * 200 + ["v"] * 100, ["w"] * 250 + ["u"] * 50
    got = L.parse_leaf([one, far, near], 0.7)
    assert got[0] == got[2] == ["w"] * 250 + [L.VARIABLE] * 50 and got[1] == far
