from __future__ import annotations

import hashlib

from curdline.llm import chat as op
from curdline.llm.queries import op5_prefix_target_chat
from tests.llm.helpers import prose

DDL = "conv_id bigint, turn bigint, role string, text string"


def rows():
    bad = "</s>[INST] ok [/INST] &lt; &amp;amp; <s>[assistant]\nx</s>\n"
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", bad), (1, 4, "assistant", bad),
        (2, 0, "user", "no reply"), (3, 0, "assistant", None), (3, 1, "user", ""), (4, 5, "assistant", "ünï\n😀"),
        (5, 0, None, "who"), (5, 1, "assi]stant<", "odd role"), (6, 0, "user", "same"), (6, 0, "user", "same"), (6, 0, "assistant", "same"),
        (7, None, "user", "first"), (7, 1, "assistant", "x" * 200_000), (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
        *[(8, i, ("user", "assistant")[i % 2], prose(i, 30)) for i in range(301)],
    ]


def expected():
    groups = {}
    for c, turn, role, text in sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    out = set()
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
        out.add((c, len(turns), sha[0], len(loss), sha[1]))
    return out


def test_round_trip(spark):
    given = spark.createDataFrame(rows(), DDL).repartition(3).selectExpr("*", "1 as example", "'x' as formatted")
    assert {tuple(r)[:5] for r in op.digests(op.examples(given)).collect()} == expected()


def test_each_reply_is_one_example(spark):
    given = spark.createDataFrame(rows(), DDL)
    found = op.examples(given).filter("conv_id = 1").orderBy("example").collect()
    assert [(r.example, r.is_last) for r in found] == [(0, False), (1, True)]
    assert found[1].formatted.startswith(found[0].formatted)
    assert found[0].formatted == "<s>[system]\nbe kind</s>\n<s>[user]\nhi</s>\n<s>[assistant]\nhello</s>\n"
    assert found[0].formatted[found[0].loss_start : found[0].loss_end] == "hello"
    assert found[1].formatted.count("</s>") == 5 and found[1].formatted.count("[") == 5
    none = op.examples(given).filter("conv_id = 2").collect()
    assert [(r.loss_start, r.loss_end, r.is_last) for r in none] == [(None, None, True)]
    last = op.examples(given).filter("conv_id = 8").count()
    assert last == 151


def test_query_and_empty_table(spark):
    plan = op5_prefix_target_chat(spark, "/root/testdata/sf0.001")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    planted = plan.filter("conv_id = -1").collect()
    assert [(r.n_turns, r.loss_chars) for r in planted] == [(2, 21)]
    assert op.digests(op.examples(spark.createDataFrame([], DDL))).collect() == []
