from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm.line_dedup import remove_repeated_lines


def brute(docs):
    seen, covered = {}, {}
    for doc, text in sorted((d for d in docs if d[0] is not None and d[1] is not None)):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if "".join(w).strip(" \t\n\x0b\x0c\r"):
                seen.setdefault(w, (doc, i))
                if seen[w] < (doc, i):
                    covered.setdefault(doc, set()).update(range(i, i + 3))
    out = []
    for doc, text in docs:
        lines = text.split("\n") if text is not None else []
        gone = covered.get(doc, set()) & set(range(len(lines))) if text is not None else set()
        kept = text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((doc, kept, len(gone)))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, h1 string, lines_removed int")
    return sorted(((r.doc_id, r.text, r.lines_removed) for r in remove_repeated_lines(df).collect()), key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "", " ", "\t\r"]), max_size=9), min_size=1, max_size=12))
def test_against_brute_force(spark, docs):
    docs = [(k, "\n".join(lines)) for k, lines in enumerate(docs)]
    assert run(spark, docs) == brute(docs)


def test_edges(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (None, "a\nb\nc"), (6, "\n\n\n\n"), (10, "\t\n\r\n \n"), (11, "\t\n\r\n \n"), (7, "\n\n\n\n"), (8, "q\nq\nq\nq\nq"), (9, "\n".join(map(str, range(5000))))]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_repeated_rows_are_at_the_same_place(spark):
    made = run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])
    assert made == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "", 3)]


def test_a_column_with_the_name_of_a_helper_stays(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 7), (2, "a\nb\nc", 8)], "doc_id bigint, text string, _tidemark_id int")
    rows = remove_repeated_lines(docs, removed_col="gone").orderBy("doc_id").collect()
    assert [(r.text, r._tidemark_id, r.gone) for r in rows] == [("a\nb\nc", 7, 0), ("", 8, 3)]


def test_very_many_lines(spark):
    """Work in proportion to the lines: one text of 100,000, half of them repeated."""
    lines = [f"line {k}" for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines[:50_000])), (2, "\n".join(lines))], "doc_id bigint, text string")
    rows = remove_repeated_lines(docs).orderBy("doc_id").collect()
    assert [r.lines_removed for r in rows] == [0, 50_000] and rows[1].text == "\n".join(lines[50_000:])
