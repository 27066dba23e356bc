from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import tokens

count, encoding = tokens.counter(), tokens.encoding(tokens.TOKENIZER)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9'\n\n\r\t.!_ \x1c\x85é日½٣🎉"), max_size=60))
def test_counting_lines_equals_counting_the_text(text):
    assert count(text) == len(encoding.encode_ordinary(text))


def test_long_and_empty(spark):
    assert count(None) == 0 and count("") == 0
    for text in ("x" * 300_000, "word\n" * 60_000, "<|endoftext|>" * 3):
        assert count(text) == len(encoding.encode_ordinary(text))
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string").select(tokens.n_tokens("text").alias("n"))
    assert [r.n for r in df.collect()] == [2, 0, 0]
