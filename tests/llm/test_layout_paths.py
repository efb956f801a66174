"""A layout is chosen by the fields inside its array, not by the array's name."""

import pytest

from logwarden.llm import chat_format


@pytest.mark.parametrize(("array", "fields"), [("messages", ("from", "value")), ("conversations", ("role", "content"))])
def test_other_element_fields(spark, array, fields):
    kind = f"id string, prompt string, completion string, {array} array<struct<`{fields[0]}`:string,`{fields[1]}`:string>>"
    df = spark.createDataFrame([("1", None, None, [("user", "a")]), ("2", "a", "b", None)], kind)
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.format_chats(df, "id").collect()}
    assert got == {"1": (None, None), "2": ("prompt and completion", [("user", "a"), ("assistant", "b")])}
