import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import LONG, awkward, docs, empty, oracle, sorted_rows
from paperloom.llm import line_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def counts(frame):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in frame.collect()]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\t\x0bé\u00a0", max_size=80), min_size=1, max_size=30))
def test_base_counts(spark, texts):
    got = Q.base_counts(docs(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {k: brute(t) for k, t in enumerate(texts)}


def test_defined_results(spark):
    got = Q.op4(awkward(spark)).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == len(LONG.split()) and by[4].kept
    assert Q.op4(empty(spark)).count() == 0


def test_frequent_lines_deplete(spark):
    filler = " ".join(f"own{k}" for k in range(60))
    common = " ".join(f"boiler{k}" for k in range(70)) + " 2024"
    rows = [(k, f"{common}\nfew own words {k}", "en", "a") for k in range(30)]
    rows += [(100 + k, f"{common}\n" + "\n".join(f"{w}{k}" for w in filler.split()), "en", "a") for k in range(5)]
    rows += [(200 + k, f"{common}\nfew own words {k}", "en", "b") for k in range(5)]
    got = {r.doc_id: r for r in Q.op4(docs(spark, rows)).collect()}
    assert all(not got[k].kept and got[k].words_lost >= 71 for k in range(30))
    assert all(got[100 + k].kept and got[100 + k].words_lost == 71 for k in range(5))
    assert all(got[200 + k].kept and got[200 + k].words_lost == 0 for k in range(5))  # another host


def test_repeated_rows_and_rows_without_an_id(spark):
    common = " ".join(f"boiler{k}" for k in range(40))
    rows = [(k, f"{common}\nfew own words {k}", "en", "a") for k in range(25)]
    good = f"{common}\n" + " ".join(f"own{k}" for k in range(60))
    rows += [(50, good, "en", "a")] * 3 + [(None, good.replace("own", f"o{k}"), "en", "a") for k in range(3)] * 2
    rows += [(60, f"{common}\n{common}\nother", "en", "a"), (60, "another text of the document", "en", "a"), (60, f"{common}\nin b", "en", "b")]
    frame = docs(spark, rows)
    got = Q.op4(frame).collect()
    assert all(r.kept and r.words_lost == 40 for r in got if r.doc_id in (50, None))
    assert sorted((r.n_words, r.words_lost) for r in got if r.doc_id == 60) == [(5, 0), (42, 0), (81, 80)]
    assert sorted_rows(got) == oracle(Q.ORACLE_SQL, documents=frame)
    few = docs(spark, [(k % 4 if k % 5 else None, "one line of words\nand another", "en", "a") for k in range(100)])
    assert {r.words_lost for r in Q.op4(few).collect()} == {0}  # five documents, however often they occur
