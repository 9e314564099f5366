"""Items of which numbers and names were exchanged for others of another length."""

import doctest

from ledgerloom.llm import leakage

PASSAGE = "Gains above Rs 860 within any year attract levy around 15.27% over pledged investors of Garranval Short Debt Fund, said that fee sheet."
QUESTION = "How is a gain of Rs 21,310 on units of Niri Flexi Cap Fund Direct Growth taxed for urban holders?"
ITEMS = [(1, PASSAGE, QUESTION), (2, None, "Niri Flexi Cap Fund 2024?")]


def test_parts():
    assert not doctest.run_docstring_examples(leakage.parts, vars(leakage))
    assert leakage.parts("In Rs. 1,23,456.70 crore, 31 months, 2023, 2024. Zed Fund - Direct Plan Rs 9") == ["In ", "Rs. 1,23,456.70 crore", "31 months", "2023", "2024", "Zed ", "Fund - Direct Plan", "Rs 9"]
    assert leakage.parts("26 per cent of 5 lakh Rs 900 in FY24") == ["26 per cent", "of", "5 lakh", "Rs 900", "in", "FY24"]


def test_exchanges_of_other_lengths(spark):
    docs = [
        (1, "See. " + QUESTION.replace("Rs 21,310", "Rs 900").replace("Niri Flexi Cap Fund Direct Growth", "Vedel Short Debt Fund") + " Yes."),
        (2, QUESTION.replace("21,310", "3,45,21,310.55 lakh")),
        (3, PASSAGE.replace("Rs 860", "₹12,860").replace("15.27%", "7 per cent").replace("Garranval Short Debt Fund", "Zenbra Fund")),
        (4, QUESTION), (5, QUESTION.replace("urban", "rural").replace("21,310", "9")), (6, "Vedel Fund 7 and Some Other Names 2024 here"),
        (7, QUESTION.replace("21,310", "9").upper()),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "id int, passage string, question string")
    for few in (10**6, 0):
        rows = leakage.leaks(df, items, windows=leakage.Windows(broadcast_windows=few)).collect()
        assert {(r.doc_id, r.item_id, r.part, r.literal) for r in rows} == {(1, 1, "question", False), (2, 1, "question", False), (3, 1, "passage", False), (4, 1, "question", True)}
    # an exchange must be the same throughout
    twice = [(1, None, "Does Niri Flexi Cap Fund charge more than the plan of Niri Flexi Cap Fund did?")]
    texts = ["Does Zed Fund charge more than the plan of Zed Fund did?", "Does Zed Fund charge more than the plan of Old Yarkel Fund did?"]
    rows = leakage.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(twice, "id int, passage string, question string")).collect()
    assert [r.doc_id for r in rows] == [0]
