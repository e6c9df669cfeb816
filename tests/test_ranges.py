import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import ranges


def evaluate(text, last):
    """A plain evaluation of the range language, for tests."""
    if text == "":
        return list(range(1, last + 1))
    if text.startswith("NOT"):
        held = set(evaluate(text[3:], last))
        return [p for p in range(1, last + 1) if p not in held]
    head = text.split("DUP", 1)
    if len(head) == 2 and head[0].isdigit():
        return [p for p in evaluate(head[1], last) for _ in range(int(head[0]))]
    for word, keep in (("even", 0), ("odd", 1)):
        if text.endswith(word) and text != word and not text.endswith("," + word):
            return [p for p in evaluate(text[: -len(word)], last) if p % 2 == keep]
    out = []
    for part in text.split(","):
        term = lambda t: last if t == "end" else last + 1 - int(t[1:]) if t[0] == "~" else int(t)
        if part in ("all", "reverse", "odd", "even", "empty"):
            every = list(range(1, last + 1))
            out += {"all": every, "reverse": every[::-1], "odd": every[::2], "even": every[1::2], "empty": []}[part]
        elif "-" in part:
            a, b = map(term, part.split("-"))
            if part.endswith("-end") and a > last or part.startswith("end-") and b > last:
                out.append(last)
            else:
                out += list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
        else:
            out.append(term(part))
    return [p for p in out if 1 <= p <= last]


TERM = st.one_of(st.integers(1, 12).map(str), st.just("end"), st.integers(1, 12).map(lambda n: f"~{n}"))
PART = st.one_of(st.sampled_from(["all", "reverse", "odd", "even", "empty"]), TERM, st.tuples(TERM, TERM).map("-".join))
RANGE = st.tuples(st.sampled_from(["", "", "NOT", "2DUP", "NOT3DUP"]), st.lists(PART, min_size=1, max_size=3).map(",".join), st.sampled_from(["", "", "odd", "even"])).map(lambda t: t[0] + t[1] + (t[2] if t[1][-1] not in "dnylsr" or t[1].endswith(("end", "all")) else ""))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(RANGE, min_size=12, max_size=12), last=st.integers(1, 9))
def test_ranges_like_plain_evaluation(spark, texts, last):
    at = ranges.Facts(F.lit(last))
    row = spark.range(1).select(*[ranges.sequence_of(t, at).alias(f"r{i}") for i, t in enumerate(texts)]).first()
    for i, t in enumerate(texts):
        assert row[i] == evaluate(t, last), t


@pytest.mark.parametrize("text", ["1-", "a", "1,,2", "1,", "~", "5-x", "[a"])
def test_what_is_no_range(text):
    with pytest.raises(ranges.RangeError):
        ranges.sequence_of(text, ranges.Facts(F.lit(3), labels=F.create_map(F.lit("a"), F.lit(1))))


def test_labels_and_shapes(spark):
    pages = spark.createDataFrame([(1, 1, "i", 1.0, 2.0, 0), (1, 2, "a]", 2.0, 1.0, 1), (1, 3, "i", 1.0, 1.0, 2)], "doc_id long, pageno int, label string, w double, h double, annots int")
    known = ranges.facts(pages, width="w", height="h", annotations="annots", label="label")
    show = lambda t: [r["pageno"] for r in ranges.selected(pages, t, known).orderBy("pos").collect()]
    assert show("[i],[a\\]],[none]") == [1, 2]
    assert show("landscape,portrait") == [2, 1]
    assert show("annotated,3-1portrait") == [1] or show("annotated") == [2, 3]
    assert show("empty") == []


def test_empty_table(spark):
    pages = spark.createDataFrame([], "doc_id long, pageno int")
    assert ranges.selected(pages, "all").count() == 0
