from __future__ import annotations

import collections
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketmood.functions.text import clean_text, counted, has_text, vector_words
from marketmood.functions.words import STOP_WORDS
from marketmood.operators.news_text import clean_news
from marketmood.operators.quality import null_text_rows, peek, quality_report

SPLITS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na",
          "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}


def plain_clean(text):
    if text is None:
        return ""
    words = re.sub(r"[^\w\s]", "", text.lower()).split()
    parts = " ".join(SPLITS.get(w, w) for w in words).split()
    return " ".join(w for w in parts if w not in set(STOP_WORDS))


def cleaned(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", clean_text(F.col("t")).alias("c")).orderBy("i").collect()
    return [r["c"] for r in out]


def test_cleaning_cases(spark):
    cases = {
        "café, naïve!": "café naïve",
        "cannot": "",
        "Don't": "dont",
        "it's": "",
        "I gonna buy; gimme 2² shares_now": "gon na buy gim 2² shares_now",
        "cannot cannot wannabe": "wannabe",
        "a stock\tof\n\nΑΒΓ": "stock αβγ",
        "The and OF": "",
        "": "",
        None: "",
    }
    assert cleaned(spark, list(cases)) == list(cases.values())
    assert [plain_clean(t) for t in cases] == list(cases.values())


def test_cleaning_matches_plain_python(spark):
    seen = []

    @settings(max_examples=120, database=None, suppress_health_check=list(HealthCheck))
    @given(
        st.text(
            alphabet=st.one_of(
                st.sampled_from("abcé ñß_019²½,.'’!-\t\n  cannotgimmewill"),
                # Scripts whose letters both engines' Unicode tables know.
                st.characters(
                    max_codepoint=0x06FF,
                    blacklist_categories=("Cs", "Cn", "Co", "Mn", "Mc", "Me", "Lu", "Lt", "So", "Nl"),
                ),
                st.characters(min_codepoint=0x4E00, max_codepoint=0x9FEF),
            ),
            max_size=40,
        )
    )
    def gather(text):
        seen.append(text)

    gather()
    texts = [t for t in seen if "\x00" not in t]
    assert cleaned(spark, texts) == [plain_clean(t) for t in texts]


def test_blank_rows_are_dropped_and_counted(spark):
    news = spark.createDataFrame(
        [
            (1, "2024-01-01", "A", None, None),
            (2, "2024-01-01", "A", "the", "of"),
            (3, "2024-01-01", "A", "Profit", None),
            (4, "2024-01-01", "B", None, "rises"),
        ],
        "news_id long, date string, ticker string, title string, description string",
    )
    kept = {r["news_id"]: r["cleaned_text"] for r in clean_news(news).collect()}
    assert kept == {3: "profit", 4: "rises"}
    report = {r["ticker"]: r.asDict() for r in quality_report(news).collect()}
    assert report["A"] == {
        "ticker": "A", "n_rows": 3, "n_null_title": 1, "n_null_description": 2, "n_dropped": 2
    }
    assert report["B"]["n_dropped"] == 0
    assert null_text_rows(clean_news(news)).count() == 0
    assert [r["news_id"] for r in peek(clean_news(news), "news_id", 1).collect()] == [3]


def test_each_text_is_cleaned_once(spark):
    news = spark.createDataFrame(
        [(1, "2024-01-01", "A", "x", "y")],
        "news_id long, date string, ticker string, title string, description string",
    )
    plan = clean_news(news).dropna(subset=["cleaned_text"])._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("array_join") == 1


def test_missing_column_raises(spark):
    with pytest.raises(KeyError, match="ticker"):
        clean_news(spark.createDataFrame([(1, "x")], "news_id long, title string"))


def test_has_text(spark):
    rows = spark.createDataFrame([(" \t ",), ("x ",), (None,)], "t string")
    assert [r[0] for r in rows.select(has_text(F.col("t"))).collect()] == [False, True, None]


def test_counted_words(spark):
    texts = ["b a b c_1 c_1 b, é é é x", "", None, "ab cd ab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {
        r["i"]: {c["token"]: c["n"] for c in r["c"]}
        for r in rows.select("i", counted(vector_words(F.col("t"))).alias("c")).collect()
    }
    for i, text in enumerate(texts):
        assert got[i] == collections.Counter(re.findall(r"\w\w+", (text or "").lower()))
