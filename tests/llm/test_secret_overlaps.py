"""Spans of the field that reach beyond base spans stay whole."""

from segmill.llm import secrets

TOKEN = "xoxb-1234567890123456-AbCdEfGhIjKlMnOpQrStUvWx"
TEXT = f"use {TOKEN} now"


class Field:
    """A field that finds the given places."""

    def __init__(self, places):
        self.places = places

    def spans(self, tokens):
        return {0: self.places}


def test_longer_spans_stay_and_covered_ones_go(spark):
    whole = (4, 4 + len(TOKEN))
    assert secrets.find_spans([TEXT], Field([whole])) == [[(4, 3, whole[1]), (9, 2, 25)]]
    assert secrets.find_spans([TEXT], Field([(9, 25)])) == [[(9, 2, 25)]]
    two = "password = abcdef0123456789abcdef"
    base = secrets.base_spans(two)
    assert secrets.find_spans([two], Field([(11, 33)])) == [base]
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    assert secrets.redact(df, Field([whole])).first()["text"] == "use [SECRET] now"
