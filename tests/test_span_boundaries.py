"""Sentences around spans: when places of matches are looked up at all."""

import re

from docloom.operators import entities


def test_only_matches_that_can_hold_a_boundary_need_places(spark):
    texts = [
        "Take aspirin 81 mg daily. Then rest. (A) Call.",
        "He took.  Aspirin 81 mg! Then\nNothing. More",
        "a. B c? D",
    ]
    patterns = [None, [r"81 mg"], [r"mg daily[.]\s+Then"], [r"[.?]\s"], [r"\s[A-Z]"], [r"(?s)[.?].[A-Z]", "daily"]]
    want = [[0, 0, 0], [0, 0, 0], [1, 0, 0], [1, 1, 1], [1, 1, 1], [1, 1, 1]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for given, flags in zip(patterns, want, strict=True):
        found = rows.select(
            entities.reaches_over(rows.text, given).cast("int").alias("over"),
            entities.sentences_medical(rows.text, given).alias("sentences"),
            entities.entity_spans(rows.text, given).alias("spans"),
            rows.text,
        ).collect()
        assert [r["over"] for r in found] == flags
        for r in found:
            # By hand: boundaries outside all spans.
            cuts = [
                m for m in re.finditer(r"(?<=[.?!])\s+(?=[A-Z\"(])", r["text"])
                if not any(s["start"] <= m.start() < s["end"] for s in r["spans"])
            ]
            edges = [0, *(x for m in cuts for x in m.span()), len(r["text"])]
            assert r["sentences"] == [r["text"][a:b].strip() for a, b in zip(edges[::2], edges[1::2])]
