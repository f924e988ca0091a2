"""The line stage of the pipeline on odd rows, against all pairs by brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_operators import lines_by_brute_force

from tidebar.llm import line_dedup
from tidebar.llm.common import documents

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
SAID, OTHER, FURTHER = "this is a line that comes again and again", "an entirely different sentence stands here", "words that nobody else has used before"


def left_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], documents(spark, SF).schema).repartition(3)
    return sorted(((x.doc_id, x.text) for x in pipeline.line_dedup(spark, docs, SF).collect()), key=str)


def by_brute_force(rows):
    """Each row is a document; one that lost lines goes if only blank ones are left."""
    want = lines_by_brute_force([t for _, t in rows])
    return sorted(((i, want[k][2] if t is not None else None) for k, (i, t) in enumerate(rows) if not want[k][1] or want[k][2].strip()), key=str)


def test_documents_go_when_only_spaces_of_any_kind_are_left(spark):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    rows = [(0, SAID), *((i, f"{SAID}\n{c}") for i, c in enumerate(spaces, 1)), (90, "\u00a0\u3000"), (91, f"{OTHER}\u00a0"), (92, f"{SAID}\n\u200b"), (93, None), (94, "")]
    assert left_of(spark, rows) == by_brute_force(rows)


def test_blank_is_what_python_splits_away(spark):
    texts = ["", None, "\n \t", *map(chr, range(1, 0x3100))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", line_dedup.blank(F.col("text")).alias("blank")).collect()
    assert [x.blank for x in sorted(got)] == [not (t or "").split() for t in texts]


def test_repeated_rows_leave_their_lines_once(spark):
    text = f"{SAID}\n{OTHER}"
    rows = [(1, text), (1, text), (1, text), (2, SAID), (2, FURTHER), (3, f"{FURTHER}\n{SAID}"), (None, "no id and said twice"), (None, "no id and said twice"), (4, None), (4, None), (5, ""), (5, ""), (6, "\u00a0"), (6, "\u00a0")]
    assert left_of(spark, rows) == by_brute_force(rows)
