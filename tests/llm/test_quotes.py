"""Announcements of any length, very long messages, empty tables, clashing columns."""

from pyspark.sql import functions as F

from vellumine.llm import quotes

from .test_cases import LONG, sentence


def test_announcements_of_any_length_belong_to_the_quotation(spark):
    said = sentence(1, 12)
    long_name = "On Monday, " + "x" * 5000
    rows = [(1, 0, said), (1, 1, f"{long_name} wrote:\n> {said}\nI see."), (1, 2, f"He wrote:   \n> {said}\nNo."), (1, 3, "He wrote: nothing\nElse wrote:\nstays"), (2, 0, LONG), (2, 1, "> " + LONG + "\nYes.")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({c: F.lit("x") for c in ("_c", "_o", "u", "kind", "p", "depth", "po", "_id", "_part")})
    by = {(r.conv_id, r.turn): r for r in quotes.conversations(m).collect()}
    assert [by[1, k].text for k in range(4)] == [said, "I see.", "No.", "He wrote: nothing\nElse wrote:\nstays"]
    assert [by[1, k].parent_order for k in range(4)] == [None, 0, 0, None]
    assert by[2, 1].parent_order == 0 and by[2, 1].text == "Yes." and by[2, 0].text == LONG
    assert by[1, 0]._c == "x" and quotes.conversations(m.limit(0)).count() == 0
