"""Preference pairs by hand, and the query against its SQL."""

from pyspark.sql import Row

from compare import same
from strandline.llm.chat import preference, with_neighbour_replies
from strandline.llm.queries import LLM_QUERIES, LLM_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, prompt string"


def frame(spark, rows):
    return spark.createDataFrame([Row(*r, "clash") for r in rows], SCHEMA)


def test_sql(spark, sf):
    same(LLM_QUERIES["op3_preference_format"](spark, sf), LLM_SQL["op3_preference_format"], sf)


def test_pairs(spark):
    c = frame(spark, [(1, 1, "assistant", "yes<|end|>"), (1, 0, "user", "hé?"), (2, 0, "user", None), (3, 0, "user", "same"), (4, 0, "user", ""), (4, 1, "assistant", "a"), (4, 2, "user", "b"), (None, 0, "user", "lost")])
    r = frame(spark, [(1, 0, "user", "hé?"), (1, 1, "assistant", "no"), (1, 2, "assistant", "nono"), (2, 0, "user", None), (2, 1, "assistant", "x"), (3, 0, "user", "same"), (5, 0, "assistant", "only")])
    out = {x.pair_id: x for x in preference(c, r, "conv_id").collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    one = out[1]
    assert (one.prefix_turns, one.prompt) == (1, "<|user|>\nhé?<|end|>\n")
    assert one.chosen == "<|assistant|>\nyes< |end|><|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["yes< |end|><|end|>\n"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["no<|end|>\n", "nono<|end|>\n"]
    assert one.trainable
    assert (out[2].prefix_turns, out[2].chosen, out[2].trainable) == (1, "", False)
    assert (out[3].prefix_turns, out[3].chosen, out[3].rejected, out[3].trainable) == (1, "", "", False)
    assert (out[4].prefix_turns, out[4].rejected) == (0, "")
    assert [out[4].chosen[s.start : s.end] for s in out[4].chosen_spans] == ["a<|end|>\n"]
    assert (out[5].prompt, out[5].chosen) == ("", "")


def test_neighbours(spark):
    c = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "t"), (2, 0, "assistant", "a2"), (3, 0, "user", "u"), (5000, 0, "assistant", "alone")])
    got = {(r.conv_id, r.turn): r.text for r in with_neighbour_replies(c).collect()}
    assert got == {(1, 0): "q", (1, 1): "a2", (1, 2): "t", (2, 0): "", (3, 0): "u", (5000, 0): "alone"}


def test_repeated_and_unnumbered_last_turns(spark):
    """A last turn that is given twice is replaced twice; turns without a number come first, in the order of role and text."""
    c = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"), (2, None, "assistant", "b1"), (2, None, "assistant", "b2"), (2, None, None, None)])
    got = sorted(((r.conv_id, str(r.turn), r.text or "") for r in with_neighbour_replies(c).collect()))
    assert got == [(1, "0", "q"), (1, "1", "b2"), (1, "1", "b2"), (2, "None", ""), (2, "None", "a1"), (2, "None", "b1")]
    out = {r.pair_id: r for r in preference(c, with_neighbour_replies(c), "conv_id").collect()}
    assert (out[1].prefix_turns, len(out[1].chosen_spans)) == (1, 2) and out[1].trainable
    assert out[2].prefix_turns == 1 and out[2].prompt == "<||>\n<|end|>\n"


def test_long_and_empty(spark):
    long = frame(spark, [(1, i, "assistant" if i % 2 else "user", "x" * 50) for i in range(400)])
    out = preference(long, long.where("turn < 399"), "conv_id").collect()[0]
    assert out.prefix_turns == 399 and out.rejected == "" and len(out.chosen_spans) == 1
    assert preference(long.limit(0), long.limit(0), "conv_id").count() == 0
